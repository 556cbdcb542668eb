"""Numbers of rows in groups that fill many partitions."""

import collections

from quillspark.operators.ordering import numbered


def test_numbered(spark):
    rows = [(None if i % 97 == 0 else "hot" if i % 3 else f"g{i % 7}", None if i % 11 == 0 else (i * 7919) % 101, f"{i % 13:02}") for i in range(3000)]
    df = spark.createDataFrame(rows, "g string, o int, t string")
    spark.conf.set("spark.sql.shuffle.partitions", "7")
    try:
        got = numbered(df, ["g"], ["o", "t"]).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    groups = collections.defaultdict(list)
    for r in got:
        groups[r["g"]].append((r["place"], r["o"], r["t"]))
    assert sorted((r["g"] or "", r["o"] or -1, r["t"]) for r in got) == sorted((g or "", o or -1, t) for g, o, t in rows)
    for own in groups.values():
        own.sort()
        assert [p for p, _, _ in own] == list(range(len(own)))
        keys = [(o is not None, o or 0, t) for _, o, t in own]
        assert keys == sorted(keys)
    assert numbered(df.limit(0), ["g"], ["o"]).count() == 0


def test_documents_in_blocks(spark):
    """One file has a third of all pages and fills many partitions; blocks end where they are full."""
    from quillspark.operators import assembly

    rows = [("hot" if i % 3 == 0 else f"f{i % 40}", i, None if i % 19 == 0 else " \r\n" if i % 23 == 0 else f"t{i}\r\n\n\n\n" + "é" * (i % 50)) for i in range(1500)]
    df = spark.createDataFrame([*rows, ("one", 0, "alone"), ("none", 0, " ")], "filename string, page int, text string")
    got = collections.defaultdict(list)
    for r in assembly.pdf_blocks(df, 200).collect():
        got[r["filename"]].append((r["block"], r["offset"], r["text"]))
    whole = {}
    for name, parts in got.items():
        parts.sort()
        at = 0
        for block, offset, text in parts:
            assert offset == at and (len(parts) == 1 or offset // 200 == block) and len(text) < 200 + 80
            at += len(text)
        whole[name] = "".join(t for *_, t in parts)
    clean = lambda t: (t or "").replace("\r\n", "\n").replace("\n\n\n\n", "\n\n").strip()
    want = {name: "\n\n".join(f"## Page {i + 1}\n\n{clean(t)}" for n, i, t in rows if n == name and clean(t)) for name in {n for n, *_ in rows}}
    assert whole == want | {"one": "alone"} and len(got["hot"]) > 20
    notes = {r["filename"]: (r["pages"], len(r["warnings"])) for r in assembly.pdf_notes(df).collect()}
    assert notes["one"] == (1, 0) and notes["none"] == (1, 1) and notes["hot"] == (500, 1)


def test_what_was_visited_is_not_shuffled_again(spark):
    """A level's anti-join reads the visited pages in their buckets, and its join with the links those in theirs."""
    from pyspark.sql import functions as F

    from quillspark.operators import crawl as C

    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    seen, graph = C.Bucketed(spark, "seen", ["root", "url"], ["depth"]), C.Bucketed(spark, "links", ["src"])
    try:
        pages = spark.range(100).selectExpr("concat('http://h', id % 3, '.test/') AS root", "concat('http://h', id % 3, '.test/', id) AS url", "'x' AS source", "lpad(id, 4, '0') AS seq", "200 AS status", "cast(null as string) AS warning", "0L AS n")
        for depth in range(3):
            seen.append(pages.where(f"url like '%{depth}'").withColumn("depth", F.lit(depth)))
        graph.append(pages.selectExpr("url AS src", "concat(url, '0') AS dst", "0 AS pos"))
        assert seen.rows().count() == 30 and seen.rows().where("depth = 1").count() == 10
        first = C._first(pages, seen.rows())
        exchanges = lambda df: [x for x in df._jdf.queryExecution().executedPlan().toString().split("\n") if "Exchange" in x]
        assert first.count() == 70 and len(exchanges(first)) == 1  # that of the level itself
        assert len(exchanges(seen.rows().join(graph.rows(), F.col("url") == F.col("src")))) == 1
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
        seen.drop()
        graph.drop()
    assert not [t.name for t in spark.catalog.listTables() if t.name.startswith(("seen", "links"))]
