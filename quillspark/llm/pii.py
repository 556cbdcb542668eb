"""PII by patterns, and information-theoretic sanitisation of the terms around it, in DataFrame functions only.

Emails, IP addresses, card numbers and phone numbers are the protected entities: each for itself, by the
part that many share (an email's domain, an address's network, the first digits of a card or phone) and
as a class. Words that stand within AROUND characters of an entity are candidate terms. Over all documents, a term t discloses an
entity e as far as its pointwise mutual information with e reaches the information content of e:
PMI(t, e) = IC(e) + log2(n(e, t) / n(t)), with IC(e) = log2(N / n(e)). Terms that reach DISCLOSURE of
IC(e), in SUPPORT different surroundings (copies of a passage count once), are spans of kind term;
sanitise() generalises entities to their kind and removes the terms.

Defined results: a null or empty text has no spans; null doc_ids are kept as null; repeated rows get
equal results and count as documents; an empty table gives an empty result; columns other than doc_id
and text are ignored. Texts are read whole.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import match_starts, materialise, renamed, texts, whole_text
from .secrets import redact

KINDS = ("email", "ip", "card", "phone")
# The same languages as the plain patterns; possessive, and entered at the start of a run or where the last match
# ended, so that very long runs take linear time and no stack.
_LOCAL = r"[A-Za-z0-9._%+-]"
PATTERNS = {
    "email": rf"(?:\G|(?<!{_LOCAL})){_LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
_OCTET = r"0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})"
AROUND = 60
SUPPORT = 3
DISCLOSURE = 0.9
#: Terms up to which a table of them goes to every task.
FEW_TERMS = 100_000
_SPAN = "struct<start: bigint, kind_no: int, end: bigint, kind: string>"


def luhn(digits: Column) -> Column:
    back = F.reverse(digits)

    def add(total: Column, i: Column) -> Column:
        d = F.substring(back, i, F.lit(1)).cast("int")
        twice = F.when(d > 4, 2 * d - 9).otherwise(2 * d)
        return total + F.when(i % 2 == 0, twice).otherwise(d)

    return F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), add) % 10 == 0


def _valid(kind: str, match: Column) -> Column:
    if kind == "email":
        return F.lit(True)
    if kind == "ip":
        return match.rlike(rf"^{_OCTET}(?:\.{_OCTET}){{3}}$")
    digits = F.regexp_replace(match, "[^0-9]", "")
    if kind == "phone":
        return F.length(digits).between(9, 15)
    return F.when(F.length(digits).between(12, 19), luhn(digits)).otherwise(F.lit(False))


def base_spans(d: DataFrame) -> DataFrame:
    """d (with text) and spans: array of (start, kind_no, end, kind), by start, then kind. No shuffle."""
    for no, kind in enumerate(KINDS):
        pattern = PATTERNS[kind]
        d = d.withColumn("_m", F.regexp_extract_all("text", F.lit(pattern), F.lit(0)))
        some = F.exists("_m", lambda m: _valid(kind, m))  # noqa: B023
        d = d.withColumn("_g", F.when(some, F.split("text", pattern, -1)))
        d = d.withColumn("_s", F.when(F.col("_g").isNotNull(), match_starts(F.col("_g"), F.col("_m"))))
        pairs = F.filter(F.arrays_zip(F.col("_m").alias("m"), F.col("_s").alias("s")), lambda x: _valid(kind, x["m"]))  # noqa: B023
        span = lambda x: F.struct(x["s"].alias("start"), F.lit(no).alias("kind_no"), (x["s"] + F.length(x["m"])).alias("end"), F.lit(kind).alias("kind"))  # noqa: B023, E731
        d = d.withColumn(f"_{kind}", F.coalesce(F.when(F.col("_s").isNotNull(), F.transform(pairs, span)), F.expr(f"cast(array() as array<{_SPAN}>)"))).drop("_m", "_g", "_s")
    return d.withColumn("spans", F.sort_array(F.concat(*(f"_{k}" for k in KINDS)))).drop(*(f"_{k}" for k in KINDS))


def protected(kind: Column, value: Column) -> Column:
    """The entities that a span stands for: itself, the part it shares with others, and its class."""
    digits = F.regexp_replace(value, "[^0-9]", "")
    shared = (
        F.when(kind == "email", F.concat(F.lit("@"), F.substring_index(value, "@", -1))).when(kind == "ip", F.concat(F.substring_index(value, ".", 3), F.lit(".")))
        .when(kind == "card", F.left(digits, F.lit(6))).otherwise(F.concat(F.lit("+"), F.left(digits, F.lit(4))))
    )
    return F.array(*(F.concat_ws(":", F.lit(level), kind, x) for level, x in (("one", value), ("part", shared), ("class", F.lit("")))))


def mentions(based: DataFrame) -> DataFrame:
    """row, entity, left, right, left_at, right_at of what each base span stands for; words cut off at the edges are left out."""
    rows = based.where(F.size("spans") > 0).select("row", "text", F.explode("spans").alias("x"))
    start, end = F.col("x.start").cast("int"), F.col("x.end").cast("int")
    first = F.greatest(start - AROUND, F.lit(0))
    left = F.substring(F.col("text"), first + 1, start - first)
    left = F.when(first > 0, F.regexp_replace(left, r"^\p{L}+", "")).otherwise(left)
    right = F.substring(F.col("text"), end + 1, F.lit(AROUND))
    right = F.when(end + AROUND < F.length("text"), F.regexp_replace(right, r"\p{L}+$", "")).otherwise(right)
    entities = protected(F.col("x.kind"), F.lower(F.substring(F.col("text"), start + 1, end - start)))
    return rows.select("row", F.explode(entities).alias("entity"), left.alias("left"), right.alias("right"), (start - F.length(left)).alias("left_at"), end.alias("right_at"))


def terms(found: DataFrame) -> DataFrame:
    """row, entity, around (hash of the surroundings), term, start, end: the words around each mention."""
    side = lambda text, at: F.struct(F.col(text).alias("text"), F.col(at).alias("at"))
    around = F.xxhash64("left", "right").alias("around")
    d = found.select("row", "entity", around, F.explode(F.array(side("left", "left_at"), side("right", "right_at"))).alias("x"))
    word = r"\p{L}+"
    d = d.withColumn("_m", F.regexp_extract_all("x.text", F.lit(word), F.lit(0))).withColumn("_g", F.split("x.text", word, -1))
    d = d.withColumn("_s", match_starts(F.col("_g"), F.col("_m"), 64))
    d = d.select("row", "entity", "around", F.col("x.at").alias("at"), F.explode(F.arrays_zip(F.col("_m").alias("m"), F.col("_s").alias("s"))).alias("w"))
    start = (F.col("at") + F.col("w.s")).cast("long")
    return d.select("row", "entity", "around", F.lower("w.m").alias("term"), start.alias("start"), (start + F.length("w.m")).alias("end"))


def disclosing(d: DataFrame, found: DataFrame, around: DataFrame) -> DataFrame:
    """entity, term of the pairs beyond the disclosure threshold. d: text of all documents.

    All counts are of rows. Each is a count of distinct (key, row), so a common entity or term is spread over the tasks
    before its few partial counts meet.
    """
    pair = ["entity", "term"]
    supported = around.select(*pair, "around").distinct().groupBy(*pair).agg(F.count("*").alias("support")).where(F.col("support") >= SUPPORT)
    supported = materialise(supported.select(*pair), "pii-supported")
    if supported.isEmpty():
        return supported
    of_entity = found.select("entity", "row").distinct().groupBy("entity").agg(F.count("*").alias("n_e"))
    of_pair = around.select(*pair, "row").join(supported, pair, "left_semi").distinct().groupBy(*pair).agg(F.count("*").alias("n_et"))
    words = d.select(F.explode(F.array_distinct(F.split(F.lower("text"), r"[^\p{L}]+"))).alias("term")).where("term <> ''")
    wanted = supported.select("term").distinct()
    if wanted.limit(FEW_TERMS + 1).count() <= FEW_TERMS:  # else all words are counted: their sums are less to shuffle than they are
        words = words.join(F.broadcast(wanted), "term", "left_semi")
    of_term = words.groupBy("term").agg(F.count("*").alias("n_t"))
    total = d.count()
    joined = materialise(of_pair, "pii-pairs").join(of_term, "term").join(of_entity, "entity")
    reveals = F.log2(F.least(F.lit(1.0), F.col("n_et") / F.col("n_t"))) >= (DISCLOSURE - 1) * F.log2(F.lit(float(max(total, 1))) / F.col("n_e"))
    return joined.where(reveals).select(*pair)


def find(docs: DataFrame) -> DataFrame:
    """doc_id, text_key, spans (base) and all_spans (those of terms too), a row for each row of docs."""
    d = texts(docs, key=True)
    based = base_spans(d)
    # Rows are numbered as they are written; repeated rows keep numbers of their own.
    kept = based.select(F.monotonically_increasing_id().alias("row"), "doc_id", "text_key", "spans", F.when(F.size("spans") > 0, F.col("text")).alias("text"))
    kept = materialise(kept, "pii-base")
    found = mentions(kept)
    around = materialise(terms(found), "pii-terms")
    hit = around.join(disclosing(d, found, around), ["entity", "term"]).select("row", F.struct("start", F.lit(len(KINDS)).alias("kind_no"), "end", F.lit("term").alias("kind")).alias("x"))
    per = hit.groupBy("row").agg(F.sort_array(F.collect_set("x")).alias("terms"))
    joined = kept.drop("text").join(per, "row", "left")
    apart = lambda t: ~F.exists("spans", lambda s: (s["start"] < t["end"]) & (t["start"] < s["end"]))
    all_spans = F.when(F.col("terms").isNull(), F.col("spans")).otherwise(F.sort_array(F.concat("spans", F.filter("terms", apart))))
    return joined.select("doc_id", "text_key", "spans", all_spans.alias("all_spans"))


def _printed(spans: str) -> Column:
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")


def pii(docs: DataFrame) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans."""
    n = lambda k: F.size(F.filter("spans", lambda x: x["kind"] == k)).cast("long").alias(f"n_{k}")
    return find(docs).select("doc_id", *map(n, KINDS), F.sha2(_printed("spans"), 256).alias("base_sha256"), _printed("all_spans").alias("spans"))


def sanitise(docs: DataFrame) -> DataFrame:
    """docs, all columns and rows; in texts, entities become [EMAIL], [IP], [CARD] or [PHONE] (where they overlap, the
    first only, widened over the rest) and disclosing terms [TERM]."""
    found = find(docs).dropDuplicates(["doc_id", "text_key"]).select(F.col("doc_id").alias("found_id"), F.col("text_key").alias("found_key"), "all_spans")
    d, names = renamed(docs)
    d = d.withColumn("whole", whole_text(F.col(names["text"]))).withColumn("text_key", F.xxhash64("whole"))
    d = d.join(found, d[names["doc_id"]].eqNullSafe(found["found_id"]) & (d["text_key"] == found["found_key"]), "left")

    def merge(done: Column, x: Column) -> Column:
        last = F.get(done, F.size(done) - 1)
        wider = F.struct(last["start"].alias("start"), last["kind_no"].alias("kind_no"), F.greatest(last["end"], x["end"]).alias("end"), last["kind"].alias("kind"))
        return F.when((F.size(done) > 0) & (last["end"] > x["start"]), F.concat(F.slice(done, F.lit(1), F.size(done) - 1), F.array(wider))).otherwise(F.concat(done, F.array(x)))

    d = d.withColumn("merged", F.aggregate("all_spans", F.expr(f"cast(array() as array<{_SPAN}>)"), merge))
    clean = redact(F.col("whole"), F.col("merged"), lambda x: F.concat(F.lit("["), F.upper(x["kind"]), F.lit("]")))
    d = d.withColumn(names["text"], F.when(F.size("merged") > 0, clean).otherwise(F.col(names["text"])))
    return d.select(*names.values()).toDF(*docs.columns)
