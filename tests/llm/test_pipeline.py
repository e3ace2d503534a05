import random
import re

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

import corpus_pipeline
from tesserae.llm import lines

from .test_jaccard import brute as brute_groups
from .test_lines import brute as brute_lines


def tables(spark, path):
    """Documents with planted junk, toxic words, copies, repeated lines and leaks; what each stage should do is known."""
    rng = random.Random(8)
    pool = ["".join(rng.choice("aeioulmnrst") for _ in range(rng.randrange(2, 8))) for _ in range(500)]
    text = lambda n: " ".join(rng.choice(pool) for _ in range(n))
    items = [(i, text(25)) for i in range(6)]
    boiler = text(60)
    docs, kind = [], {}
    for i in range(240):
        t, k = "\n".join(text(rng.randrange(10, 50)) for _ in range(rng.randrange(1, 5))), "good"
        r = rng.random()
        if r < 0.12:
            w = t.split(" ")
            for _ in range(4):
                w.insert(rng.randrange(len(w)), "vlkk" + rng.choice("abc"))
            t, k = " ".join(w), "toxic"
        elif r < 0.24:
            t, k = re.sub(r"(\w+)", r"\1%%%", t), "junk"
        elif r < 0.34:
            t, k = t + "\n" + boiler, "boiler"
        elif r < 0.44 and docs and kind[i - 1] == "good":
            t, k = docs[-1][1].replace(" ", "  ", 1).rsplit(" ", 1)[0] + " end", "copy"
        elif r < 0.54:
            t, k = t + " " + rng.choice(items)[1] + " " + text(8), "leak"
        docs.append((i, t, "en", f"src{i % 3}", len(t)))
        kind[i] = k
    docs += [(900, None, "en", "x", 0), (901, "", "en", "x", 0)]
    labels = [(i, int(k != "junk"), int(k == "toxic")) for i, k in kind.items() if i % 2]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return docs, kind, items


def test_run_against_plain_version(spark, tmp_path):
    docs, kind, items = tables(spark, str(tmp_path))
    got = {r.doc_id: r for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    good = [(i, t) for i, t, *_ in docs if kind.get(i) not in ("toxic", "junk")]
    texts = brute_lines(good)
    kept = {i for i, _, c in brute_groups(list(texts.items())) if i == c}
    words = lambda t: re.findall(r"[a-z0-9]+", (t or "").lower())
    phrases = [f" {' '.join(words(t))} " for _, t in items]
    kept = {i for i in kept if not any(p in f" {' '.join(words(texts[i]))} " for p in phrases)}
    assert set(got) == kept and {900, 901} <= kept
    assert len(kept) < len(good) - 20
    tok = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    for i, r in got.items():
        assert np.frombuffer(r.ids, "<u4").tolist() == tok.encode(texts[i] or "", add_special_tokens=False).ids


def test_stages_keep_columns(spark, tmp_path):
    docs, _, _ = tables(spark, str(tmp_path))
    df = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, df, str(tmp_path))
        assert out.columns == df.columns, name
        assert stage(spark, df.limit(0), str(tmp_path)).count() == 0, name
    assert lines.WINDOW == 3
