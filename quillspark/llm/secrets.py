"""Secret scans: candidates by pattern, false positives removed by a random forest, in DataFrame functions only.

Candidates are private key blocks, values assigned to a word like password or token (any six or more
characters up to white space or a quote), access key ids, and tokens of twelve or more characters with
letters and a digit. The forest is trained on labelled findings (value, left, right, source, label)
from length, character transitions (mean log likelihood of letter pairs under those of a dictionary),
dictionary coverage, path and neighbouring words; its trees are then applied as conditional
expressions inside each row, so scanning needs no shuffle.

Defined results: a null or empty text has no candidates; null doc_ids and sources are kept or count
as empty; repeated rows get equal results; an empty table gives an empty result; columns other than
doc_id, text and source are ignored. Texts are scanned whole. Secrets are returned as hashes only.
"""

from __future__ import annotations

import functools
import json
import math
import re
import string
from collections.abc import Callable

from pyspark.ml.classification import RandomForestClassificationModel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import match_starts, materialise, renamed, whole_text

_CHARS = "A-Za-z0-9+/_-"
_NAMES = r"pass(?:word|wd|phrase)?|pwd|secret|token|api[_-]?key|access[_-]?key|secret[_-]?key|auth(?:orization)?|credentials?"
#: What stands between an assigned value and the text before it: a name, a sign, a scheme and a quote.
_ASSIGNS = rf"(?i:{_NAMES})[\"']?\x20{{0,3}}(?:=>?|:)\x20{{0,3}}(?:(?i:bearer|basic)\x20{{1,3}})?[\"'`]?"
_BLOCK = r"-----BEGIN (?:[A-Z]{1,12} )?PRIVATE KEY-----"
CANDIDATE = (
    rf"{_BLOCK}(?:(?:\s*[A-Za-z-]+: [^\n]*\n)*+[A-Za-z0-9+/=\s]*+-----END (?:[A-Z]{{1,12}} )?PRIVATE KEY-----)?+"
    rf"|{_ASSIGNS}[^\s\"'`<>]{{6,}}+"
    rf"|(?<![{_CHARS}])(?:AKIA[0-9A-Z]{{16}}(?![{_CHARS}])|[A-Za-z+/_-]*+[0-9][{_CHARS}]*+={{0,2}})"
)
LEAST, LEAST_ASSIGNED = 12, 6
AROUND = 40
TREES, DEPTH, SEED = 25, 8, 11
#: Words of the dictionary, the first of a vocabulary; letters in a shortest word.
WORDS, SHORTEST = 4000, 4

# Neighbouring words that speak for or against a secret, and how provider keys begin.
FOR = rf"(?i)(?:{_NAMES}|bearer|private)[^\n]{{0,12}}$"
AGAINST = r"(?i)(?:commit|sha-?[0-9]*|md5|checksum|digest|uuid|guid|hash|revision|etag|build|version|invoice|order|isbn|serial|example|sample|dummy|placeholder|href|src|image|file|path)[^\n]{0,12}$"
PREFIXES = r"^(?:AKIA|ASIA|gh[pousr]_|xox[abprs]-|sk_live_|AIza|eyJ|glpat-|-----BEGIN)"


@functools.cache
def dictionary(vocabulary: str, most: int = WORDS) -> tuple[str, ...]:
    """The first words of plain letters in a vocabulary file, in the order of its ids; tokens that end a word have </w>."""
    with open(vocabulary) as f:
        ids = json.load(f)["model"]["vocab"]
    words = (k.removesuffix("</w>") for k in sorted(ids, key=ids.get) if k.endswith("</w>"))
    return tuple([w for w in words if len(w) >= SHORTEST and w.isascii() and w.isalpha()][:most])


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def transitions(words: tuple[str, ...]) -> list[float]:
    """Log likelihood of each pair of the 27 classes (0: no letter, 1 to 26: a to z) beside an even spread, pair (i, j) at
    27 * i + j, as words have them, each between two non-letters; one is added to all counts."""
    counts = [1.0] * 27 * 27
    for w in words:
        codes = [0, *(ord(c) - 96 for c in w), 0]
        for i, j in zip(codes, codes[1:]):
            counts[27 * i + j] += 1
    return [math.log(27 * c / sum(counts[27 * (k // 27) : 27 * (k // 27) + 27])) for k, c in enumerate(counts)]


def _share(value: Column, pattern: str) -> Column:
    return F.length(F.regexp_replace(value, pattern, "")) / F.greatest(F.length(value), F.lit(1))


FEATURES = ["length", "transitions", "classes", "digits", "capitals", "dictionary", "path", "hex", "words_for", "words_against", "prefix", "joints", "marks", "assigned"]


def _features(value: Column, left: Column, right: Column, source: Column, words: tuple[str, ...]) -> list[Column]:
    classes = F.regexp_replace(F.regexp_replace(F.regexp_replace(value, "[a-z]+", "a"), "[A-Z]+", "A"), "[0-9]+", "0")
    size = F.greatest(F.length(value), F.lit(1))
    parted = F.lower(F.regexp_replace(value, "([a-z])([A-Z])", "$1 $2"))
    # Constants as one literal each, which Catalyst folds: the words by their first letter, and the table.
    initial = F.split(F.lit("|".join(" ".join(["", *(w for w in words if w[0] == c), ""]) for c in string.ascii_lowercase)), r"\|")
    table = F.split(F.lit(" ".join(f"{x:.4f}" for x in transitions(words))), " ").cast("array<double>")
    known = F.filter(F.regexp_extract_all(parted, F.lit(f"[a-z]{{{SHORTEST},}}"), F.lit(0)), lambda w: F.get(initial, F.ascii(w) - 97).contains(F.concat(F.lit(" "), w, F.lit(" "))))
    covered = F.aggregate(known, F.lit(0), lambda a, w: a + F.length(w))
    codes = F.transform(F.split(parted, ""), lambda c: F.when(c.between("a", "z"), F.ascii(c) - 96).otherwise(0))
    steps = F.zip_with(codes, F.slice(codes, 2, F.size(codes)), lambda i, j: F.when((i > 0) | (j > 0), F.get(table, 27 * i + j)))
    steps = F.filter(steps, lambda x: x.isNotNull())
    flow = F.aggregate(steps, F.lit(0.0), lambda a, x: a + x) / F.greatest(F.size(steps), F.lit(1))
    flag = lambda c: F.when(F.coalesce(c, F.lit(False)), 1.0).otherwise(0.0)
    return [x.cast("double") for x in (
        F.length(value),
        flow,
        F.length(classes) / size,
        _share(value, "[^0-9]"),
        _share(value, "[^A-Z]"),
        covered / size,
        flag(value.contains("/") | left.rlike(r"[/\\.]$") | right.rlike(r"^(?:/|\.[a-z])") | source.rlike(r"(?i)test|example|sample|fixture|docs?/")),
        flag(value.rlike("^[0-9a-fA-F-]+$")),
        flag(left.rlike(FOR)),
        flag(left.rlike(AGAINST)),
        flag(value.rlike(PREFIXES)),
        _share(value, "[^-_/+]"),
        _share(value, "[-_/+A-Za-z0-9]"),
        flag(left.rlike(_ASSIGNS + "$")),
    )]


def labelled_findings(spark: SparkSession, rows: int = 6000, held_out: bool = False) -> DataFrame:
    """kind, value, left, right, source, label: findings made by rule; secrets as they are assigned and sent, and digests,
    ids, paths, placeholders and prose that look like them. held_out: of other kinds, which training never sees."""
    h = lambda salt: f"sha2(concat(id, '{salt}'), 512)"
    n = lambda salt, m: f"cast(pmod(xxhash64(id, '{salt}'), {m}) as int)"
    pick = lambda salt, *xs: "element_at(array(" + ", ".join(repr(x) for x in xs) + f"), 1 + {n(salt, len(xs))})"
    b64 = f"translate(base64(unhex({h('b')})), '+/=', 'xyz')"
    letters = f"translate({b64}, '0123456789', 'qwzxkvjypb')"
    length = f"18 + {n('n', 24)}"
    name = pick("name", "password", "secret", "api_key", "token", "pwd", "access_key", "passwd")
    sets = f"concat({name}, {pick('sign', ' = ', '=', ': ', ' => ')}, {pick('quote', '', '', chr(34))})"
    word = lambda salt: pick(salt, "river", "window", "market", "garden", "simple", "number", "summer", "letter", "people", "orange")
    odd = pick("odd", "!", "@", "#", "$", "%", "&", "*")
    src, docs = "'src'", "'docs/example'"
    seen = [
        ("assigned hex", f"substr({h('a')}, 1, {length})", sets, "' and'", src, 1),
        ("assigned token", f"substr(concat('1', {b64}), 1, {length})", sets, pick("r1", "\n", "' the", " and"), src, 1),
        ("assigned letters", f"substr({letters}, 1, {length})", sets, "' then'", src, 1),
        ("password with marks", f"concat(substr({letters}, 1, 3 + {n('m', 5)}), {odd}, {n('d', 1000)}, substr({b64}, 9, 2))", sets, "'\\n'", src, 1),
        ("short password", f"concat(substr({letters}, 3, 5), {n('d', 99)})", sets, "' for'", src, 1),
        ("password of words", f"concat({word('w1')}, {odd}, upper(substr({letters}, 1, 3)), {n('d', 1000)})", sets, "''", src, 1),
        ("named in prose", f"substr(concat('1', {b64}), 1, {length})", "'the secret is '", "'. Then'", src, 1),
        ("access key id", f"concat('AKIA', substr(upper(translate({b64}, 'iloqxyz', '2345678')), 1, 16))", pick("l2", "of the ", "id = ", ""), "' with'", src, 1),
        ("provider token", f"concat({pick('p', 'ghp_', 'xoxb-', 'sk_live_', 'AIza')}, substr({b64}, 1, 34))", "'with '", "' end'", src, 1),
        ("key header", "'-----BEGIN RSA PRIVATE KEY-----'", "'\\n'", "'\\nMII'", src, 1),
        ("key block", f"concat('-----BEGIN PRIVATE KEY-----\\n', {b64}, '\\n', {b64}, '\\n-----END PRIVATE KEY-----')", "'\\n'", "'\\n'", src, 1),
        ("bearer", f"substr(concat('1', {b64}), 1, {length})", "'Authorization: Bearer '", "''", src, 1),
        ("commit", f"substr({h('c')}, 1, 40)", pick("l3", "in commit ", "commit=", "revision "), "' we'", src, 0),
        ("digest", f"substr({h('c')}, 1, 64)", pick("l4", "sha256:", "digest = ", "sha512 "), "' of'", src, 0),
        ("checksum", f"substr({h('c')}, 1, 32)", pick("l5", "md5 checksum ", "etag: ", "hash "), "' file'", src, 0),
        ("uuid", f"concat_ws('-', substr({h('d')},1,8), substr({h('d')},9,4), substr({h('d')},13,4), substr({h('d')},17,4), substr({h('d')},21,12))", pick("l6", "uuid ", "id=", "the "), "','", src, 0),
        ("path", f"concat('/usr/share/', {word('w1')}, '-', {n('d', 97)}, '/', {word('w2')}, '-', {n('e', 13)})", "'see '", "'/file'", src, 0),
        ("placeholder", f"concat({pick('x', 'example', 'sample', 'dummy', 'your')}, {pick('y', '_', '-')}, {pick('z', 'token', 'password', 'secret')}, {pick('v', '', '_1', '-here', '123')})", sets, "'\"'", docs, 0),
        ("placeholder in source", f"concat({pick('x', 'your', 'change', 'my', 'test')}, {pick('y', '_', '-', '')}, {pick('z', 'token', 'password', 'secret', 'value')})", sets, "' here'", src, 0),
        ("masked", f"concat({pick('x', '<', '$' + '{', '%', '*****')}, {word('w1')}, {pick('y', '>', '}', '%', '***')})", sets, "''", src, 0),
        ("assigned word", word("w1"), sets, "' of the'", src, 0),
        ("assigned name", f"concat({word('w1')}, '.', {word('w2')}, {pick('y', '()', '', '.get(', '_id')})", sets, "''", src, 0),
        ("room", f"concat('Room', {n('d', 90)}, '-', {word('w1')}, 'building')", "'met in '", "' at'", src, 0),
        ("time", f"concat('2024-', lpad({n('d', 12)} + 1, 2, '0'), '-', lpad({n('e', 28)} + 1, 2, '0'), 'T10-00')", pick("l7", "on ", "date: "), "' the'", src, 0),
        ("compound", f"concat({word('w1')}, {n('d', 30)}, {word('w2')}, 's')", "'of '", "' and'", src, 0),
        ("hex page", f"substr({h('e')}, 1, {length})", "'the page '", "'.html'", src, 0),
        ("image address", f"substr(concat('1', {b64}), 1, {length})", "'https://host/image/'", "'.png'", src, 0),
    ]
    unseen = [
        ("quoted json", f"substr(concat('7', {b64}), 1, {length})", "'{\"client_secret\": \"'", "'\"}'", src, 1),
        ("connection string", f"concat(substr({letters}, 5, 8), {odd}, {n('d', 100)})", "'host=db user=app password='", "' port=5'", src, 1),
        ("query parameter", f"substr({h('q')}, 1, {length})", "'https://host/run?token='", "' now'", src, 1),
        ("shell export", f"substr({letters}, 1, {length})", "'export API_KEY='", "'\\nrun'", src, 1),
        ("gitlab token", f"concat('glpat-', substr({b64}, 1, 20))", "'use '", "' to'", src, 1),
        ("encrypted key block", f"concat('-----BEGIN EC PRIVATE KEY-----\\nProc-Type: 4,ENCRYPTED\\n\\n', {b64}, '\\n-----END EC PRIVATE KEY-----')", "':\\n'", "'\\n'", src, 1),
        ("git log line", f"substr({h('g')}, 1, 40)", "'\\ncommit '", "'\\nAuthor'", src, 0),
        ("package version", f"concat({word('w1')}, '-', {n('d', 9)}, '-', {n('e', 20)}, '-', {word('w2')})", "'install '", "' first'", src, 0),
        ("measured word", f"concat('approximately', {n('d', 900)}, 'kilometres')", "'was '", "' from'", src, 0),
        ("prompt", pick("x", "required", "forgotten?", "incorrect", "protected"), "'The password: '", "' by the'", src, 0),
        ("variable", f"concat('self.', {word('w1')}, '_', {word('w2')})", "'token = '", "'\\n'", src, 0),
        ("integrity", f"substr({h('i')}, 1, 64)", "'integrity sha256-'", "'\"'", src, 0),
    ]
    kinds = unseen if held_out else seen
    made = [spark.range(k, rows, len(kinds), 1).selectExpr(f"'{kind}' as kind", f"{v} as value", f"{le} as left", f"{ri} as right", f"{so} as source", f"{la} as label") for k, (kind, v, le, ri, so, la) in enumerate(kinds)]
    return functools.reduce(DataFrame.union, made).coalesce(1)


def featured(findings: DataFrame, words: tuple[str, ...]) -> DataFrame:
    """findings (value, left, right, source, label and others) and FEATURES."""
    cols = _features(*(whole_text(F.col(c)) for c in ("value", "left", "right", "source")), words)
    return findings.withColumns(dict(zip(FEATURES, cols)))


def fit(findings: DataFrame, words: tuple[str, ...], trees: int = TREES, depth: int = DEPTH, seed: int = SEED) -> RandomForestClassificationModel:
    """A random forest over labelled findings: value, left, right, source, label."""
    from pyspark.ml.classification import RandomForestClassifier
    from pyspark.ml.feature import VectorAssembler

    rows = featured(findings.where("value is not null and label in (0, 1)"), words).select(*FEATURES, F.col("label").cast("double").alias("label"))
    rows = materialise(rows, "secret-findings")  # read once for each level of the trees
    vectors = VectorAssembler(inputCols=FEATURES, outputCol="features").transform(rows)
    return RandomForestClassifier(numTrees=trees, maxDepth=depth, seed=seed, labelCol="label", featuresCol="features").fit(vectors)


def train(findings: DataFrame, words: tuple[str, ...]) -> list[str]:
    """The trees of a random forest over labelled findings, as printed lines."""
    return fit(findings, words).toDebugString.split("\n")


def forest_score(lines: list[str]) -> Callable[[list[Column]], Column]:
    """The share of trees that vote for a secret, as a function of the feature columns."""
    starts = [i for i, x in enumerate(lines) if x.strip().startswith("Tree ")]

    def tree(features: list[Column], at: int) -> tuple[Column, int]:
        line = lines[at].strip()
        if line.startswith("Predict:"):
            return F.lit(float(line.split(":")[1])), at + 1
        m = re.fullmatch(r"If \(feature (\d+) <= (\S+)\)", line)
        below, at = tree(features, at + 1)
        above, at = tree(features, at + 1)  # past the line with Else
        return F.when(features[int(m[1])] <= float(m[2]), below).otherwise(above), at

    def score(features: list[Column]) -> Column:
        votes = [tree(features, i + 1)[0] for i in starts]
        total = votes[0]
        for v in votes[1:]:
            total = total + v
        return total / len(votes)

    return score


_FOUND = "array<struct<start: bigint, end: bigint, value: string, kind: string, score: double, secret: boolean>>"


def findings(d: DataFrame, forest: list[str] | None = None, vocabulary: str | None = None, least_score: float = 0.5) -> DataFrame:
    """d (with whole and origin, the text and source without nulls) and found: array of (start, end, value, kind, score,
    secret) of every candidate, in text order."""
    words = dictionary(vocabulary or default_vocabulary())
    score = forest_score(train(labelled_findings(d.sparkSession), words) if forest is None else forest)
    before = list(d.columns)
    d = d.withColumn("matches", F.regexp_extract_all("whole", F.lit(CANDIDATE), F.lit(0)))
    lead = lambda m: F.length(F.regexp_extract(m, f"^{_ASSIGNS}", 0))
    # The value of an assignment starts behind its name; marks that end a sentence or close a bracket are left out.
    value = lambda m: F.regexp_replace(F.substring(m, lead(m) + 1, F.length(m)), r"(?<![-=])[.,:;!?)\]}]+$", "")
    wanted = lambda m: F.when(lead(m) > 0, F.length(value(m)) >= LEAST_ASSIGNED).otherwise((F.length(m) >= LEAST) & m.rlike("[A-Za-z]"))
    some = F.exists("matches", wanted)
    d = d.withColumn("gaps", F.when(some, F.split("whole", CANDIDATE, -1)))
    d = d.withColumn("at", F.when(F.col("gaps").isNotNull(), match_starts(F.col("gaps"), F.col("matches"))))
    pairs = F.filter(F.arrays_zip(F.col("matches").alias("m"), F.col("at").alias("s")), lambda x: wanted(x["m"]))
    parts = F.transform(pairs, lambda x: F.struct(value(x["m"]).alias("value"), (x["s"] + lead(x["m"])).alias("start")))
    d = d.withColumn("parts", F.when(F.col("at").isNotNull(), parts))

    def around(x: Column) -> Column:
        v, s = x["value"], x["start"].cast("int")
        first = F.greatest(s - AROUND, F.lit(0))
        left = F.substring(F.col("whole"), first + 1, s - first)
        right = F.substring(F.col("whole"), s + F.length(v) + 1, F.lit(AROUND))
        return F.struct(x["start"].alias("start"), v.alias("value"), F.array(*_features(v, left, right, F.col("origin"), words)).alias("f"))

    d = d.withColumn("featured", F.transform("parts", around))

    def verdict(x: Column) -> Column:
        p = score([F.get(x["f"], i) for i in range(len(FEATURES))])
        v = x["value"]
        kind = F.when(v.startswith("-----BEGIN"), "private_key").when(v.rlike(PREFIXES), "provider_key").when(v.rlike("^[0-9a-fA-F]+$"), "hex").otherwise("token")
        return F.struct(x["start"].alias("start"), (x["start"] + F.length(v)).alias("end"), v.alias("value"), kind.alias("kind"), p.alias("score"), (p >= least_score).alias("secret"))

    return d.select(*before, F.coalesce(F.transform("featured", verdict), F.expr(f"cast(array() as {_FOUND})")).alias("found"))


def secret_scan(docs: DataFrame, forest: list[str] | None = None, vocabulary: str | None = None) -> DataFrame:
    """One row for each candidate: doc_id, start, end (code points, end exclusive), kind, score, is_secret, value_sha256."""
    origin = whole_text(F.col("source")) if "source" in docs.columns else F.lit("")
    found = findings(docs.select("doc_id", whole_text(F.col("text")).alias("whole"), origin.alias("origin")), forest, vocabulary)
    rows = found.select("doc_id", F.explode("found").alias("x"))
    return rows.select("doc_id", F.col("x.start").alias("start"), F.col("x.end").alias("end"), "x.kind", "x.score", F.col("x.secret").alias("is_secret"), F.sha2("x.value", 256).alias("value_sha256"))


def redact(text: Column, spans: Column, mask: Callable[[Column], Column]) -> Column:
    """text with each of spans (start, end; in order, not overlapping) replaced by its mask."""
    step = lambda a, x: F.struct(F.concat(a["done"], F.array(F.substring(text, a["at"] + 1, x["start"].cast("int") - a["at"]), mask(x))).alias("done"), x["end"].cast("int").alias("at"))
    out = F.aggregate(spans, F.struct(F.expr("cast(array() as array<string>)").alias("done"), F.lit(0).alias("at")), step)
    return F.concat(F.array_join(out["done"], ""), F.substring(text, out["at"] + 1, F.length(text)))


def redact_secrets(docs: DataFrame, forest: list[str] | None = None, vocabulary: str | None = None) -> DataFrame:
    """docs, all columns and rows; secrets in texts become [SECRET], and n_chars, where docs has it, follows."""
    d, names = renamed(docs)
    origin = whole_text(F.col(names["source"])) if "source" in names else F.lit("")
    d = d.withColumn("whole", whole_text(F.col(names["text"]))).withColumn("origin", origin)
    d = findings(d, forest, vocabulary).withColumn("spans", F.filter("found", lambda x: x["secret"]))
    hit, text = F.size("spans") > 0, names["text"]
    d = d.withColumn(text, F.when(hit, redact(F.col("whole"), F.col("spans"), lambda x: F.lit("[SECRET]"))).otherwise(F.col(text)))
    if "n_chars" in names:
        n = names["n_chars"]
        d = d.withColumn(n, F.when(hit, F.length(text).cast(docs.schema["n_chars"].dataType)).otherwise(F.col(n)))
    return d.select(*names.values()).toDF(*docs.columns)
