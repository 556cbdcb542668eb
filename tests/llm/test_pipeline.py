"""The pipeline stage by stage, each on what the one before it kept, against plain versions."""

import hashlib
import itertools
import random
import zlib

import duckdb
import numpy as np
import pytest
from test_operators import WORDS, _shingle_set, _words

import corpus_pipeline
from quillspark.llm.queries import ORACLE_SQL


def _rows():
    r = random.Random(9)
    text = lambda n: " ".join(r.choice("aeiou") + "".join(r.choice("bcdfglmnrst") for _ in range(r.randint(2, 6))) for _ in range(n)) + "."
    base, passage, key = text(120), text(50), hashlib.sha1(b"key").hexdigest()
    near = base.split()
    near[60] = "altered"
    made = [base, " ".join(near), base, text(80) + " " + passage + " " + text(70), text(60) + " " + passage + " " + text(60), text(90) + f'\ntoken = "{key}" ends here', text(20), "x " * 200, "", None, text(5000), "# * $ " * 100]
    return [(i, t, "en", "src", len(t or "")) for i, t in enumerate(made)] + [(None, text(70), None, None, None)]


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    """The directory of documents and the rows of each stage."""
    folder = tmp_path_factory.mktemp("pipeline")
    docs = spark.createDataFrame(_rows(), "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{folder}/documents.parquet")
    out = [docs]
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, out[-1], str(folder)).write.parquet(f"{folder}/{name}")
        out.append(spark.read.parquet(f"{folder}/{name}"))
    return str(folder), out


def _sql(df, name):
    con = duckdb.connect()
    con.register("documents", df.toPandas().astype({"doc_id": "Int64"}))
    return con.execute(ORACLE_SQL[name]).df()


def test_stages(stages):
    folder, (docs, good, apart, cut, clean, packed) = stages
    assert all(x.columns == docs.columns for x in (good, apart, cut, clean))
    want = _sql(docs, "op1_quality_rules")
    key = lambda ids: sorted(map(str, ids))
    assert key(r["doc_id"] for r in good.collect()) == key(None if x != x else int(x) for x in want[want.kept].doc_id.astype(float))
    assert 0 < good.count() < docs.count()

    texts = {r["doc_id"]: r["text"] for r in good.collect()}
    kept = {r["doc_id"] for r in apart.collect()}
    sets = {i: _shingle_set(t) for i, t in texts.items()}
    close = lambda i, j: len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])
    assert not any(close(i, j) for i, j in itertools.combinations(kept, 2)) and all(any(close(i, j) for j in kept) for i in sets.keys() - kept)
    assert len({0, 1, 2} & kept) == 1

    want = {None if x != x else int(x): (h, n) for x, h, n in zip(*(lambda d: (d.doc_id.astype(float), d.kept_sha256, d.n_removed))(_sql(apart, "op2_substring_dedup")))}
    assert {r["doc_id"]: hashlib.sha256(" ".join(_words(r["text"])).encode()).hexdigest() for r in cut.collect()} == {i: h for i, (h, _) in want.items()}
    assert want[3][1] >= 50 and want[4][1] >= 50 and sum(n > 0 for _, n in want.values()) == 2

    secret = hashlib.sha1(b"key").hexdigest()
    before = {r["doc_id"]: r["text"] for r in cut.collect()}
    after = {r["doc_id"]: (r["text"], r["n_chars"]) for r in clean.collect()}
    assert {i: t for i, (t, _) in after.items()} == {i: t.replace(secret, "[SECRET]") for i, t in before.items()} and "[SECRET]" in after[5][0]
    assert all(n == len(t) for i, (t, n) in after.items() if i in (3, 4, 5))

    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(WORDS)
    ids = {i: np.array([*tok.encode(t, add_special_tokens=False).ids, 1], "<u4") for i, (t, _) in after.items()}
    pieces = {(i, k, zlib.crc32(x[a : a + 4096].tobytes())) for i, x in ids.items() for k, a in enumerate(range(0, len(x), 4096))}
    assert {(r["doc_id"], r["piece"], r["ids_crc32"]) for r in packed.collect()} == pieces
    lengths = packed.groupBy("sequence_id").sum("length").collect()
    assert all(r[1] <= 4096 for r in lengths) and len(lengths) == -(-sum(map(len, ids.values())) // 4096)


def test_run_is_its_stages(spark, stages):
    folder, out = stages
    columns = ["doc_id", "piece", "start", "length", "ids_crc32"]
    rows = lambda df: sorted(map(str, df.select(*columns).collect()))
    assert rows(corpus_pipeline.run(spark, folder)) == rows(out[-1])
