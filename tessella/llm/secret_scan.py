"""Secret scans: fixed patterns, and character Markov models of random strings and ordinary identifiers.

Three base patterns give spans by themselves. Beyond them, runs of 20 or more characters of keys are scored by the
log-likelihood ratio of two first-order character models, trained on labelled samples: random strings (base64, base62, hex,
base32) and identifiers (words in camel, snake, kebab and path style, and lower-case runs of syllables). Base spans are cut
out first, and what is left of a run is one if it has 20 characters. A run whose ratio exceeds the threshold is a span of
kind `markov`; of another run the stretches are that exceed it, so that a path or a name before a key doesn't hide it. A
stretch ends where its ratio, less the threshold a character, falls to 0 or by LEAST below its height. Built-in functions only.

The samples are `SAMPLES` strings of each label, made from hashes of their numbers; the model is a table of at most
68 x 68 ratios, whatever the input.

Defined cases: null text is empty and has no spans; rows that repeat are scanned each; an empty table gives no rows;
positions count code points, ends are exclusive; a very long text is scanned whole, as the one value that it is; further
columns are not looked at.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{12,}"
HEX = r"[0-9a-f]{32,}"
RUN = r"[A-Za-z0-9+/_=-]{20,}"
KINDS = ("assign", "access", "hex", "markov")
ALPHABET = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/_=-."
SAMPLES = 20_000
#: Nats by which a run must be likelier under the model of random strings, in all and per character.
LEAST, LEAST_EACH = 12.0, 0.35
WORDS = (
    "get set is has make new old add remove delete update insert find search match parse format read write open close load store save "
    "file path name node list map array index key value item entry row column table field type kind class method function symbol "
    "user account order customer price total count size length width height color image page view event error message status state "
    "request response server client socket stream buffer cache queue stack thread process task job worker handler listener manager "
    "config option setting default context session service factory builder provider resolver visitor adapter wrapper helper util "
    "test mock assert check verify validate compute render print debug trace start stop begin end next last first prev parent child"
).split()
SYLLABLES = (
    "th er on an re he in ed nd ha at en es of or nt ea ti to it st io le is ou ar as de rt ve ing tion ment able ly ent ness ung keit lich schaft "
    "ver be ge ein auf sch ie que les des mente ado cion ar os as eur eux aux oi ai tre elle ier"
).split()


def _pick(words: list[str], h: Column, k: int) -> Column:
    """A word by the k-th part of a hash in hex."""
    return F.element_at(F.lit(words), (F.conv(F.substring(h, 1 + 4 * k, 4), 16, 10).cast("int") % len(words)) + 1)


def labelled(spark: SparkSession, n: int = SAMPLES) -> DataFrame:
    """(random boolean, text): n random strings and n identifiers."""
    base = spark.range(n).withColumn("h", F.sha2(F.concat(F.lit("sample:"), F.col("id").cast("string")), 512))
    size = (F.lit(20) + F.pmod(F.hash("h"), F.lit(44))).cast("int")
    b64 = F.base64(F.unhex("h"))
    style = F.pmod(F.col("id"), F.lit(5))
    alphanumeric = F.regexp_replace(b64, r"[^A-Za-z0-9]", "x")
    random = F.when(style == 0, b64).when(style == 1, F.translate(b64, "+/=", "-_")).when(style == 2, alphanumeric).when(style == 3, F.upper(F.regexp_replace(b64, r"[^A-Za-z2-7]", "Q"))).otherwise(F.col("h"))
    w = [_pick(WORDS, F.col("h"), k) for k in range(5)]
    s = [_pick(SYLLABLES, F.col("h"), 6 + k) for k in range(10)]
    cap = [F.initcap(x) for x in w]
    plain = (
        F.when(style == 0, F.concat(w[0], *cap[1:]))
        .when(style == 1, F.concat_ws("_", *w))
        .when(style == 2, F.concat(F.concat_ws("/", *w[:4]), F.lit("-"), w[4], F.pmod(F.col("id"), F.lit(100)).cast("string")))
        .when(style == 3, F.concat(*s))
        .otherwise(F.concat(F.upper(F.concat_ws("_", *w[:3])), F.lit("="), F.initcap(F.concat(*s[:6]))))
    )
    return base.select(F.lit(True).alias("random"), F.substring(random, F.lit(1), size).alias("text")).unionByName(base.select(F.lit(False).alias("random"), plain.alias("text")))


def _codes(text: Column) -> Column:
    """1 to 68 for each character of the alphabet; the others are left out."""
    return F.filter(F.transform(F.split(text, ""), lambda c: F.instr(F.lit(ALPHABET), c)), lambda x: x > 0)


def train(samples: DataFrame) -> list[float]:
    """The log-likelihood ratio of each pair of following characters, row by row, from rows (random, text)."""
    n = len(ALPHABET)
    codes = samples.where("text is not null").select("random", _codes(F.col("text")).alias("c"))
    pairs = codes.where(F.size("c") > 1).select("random", F.explode(F.zip_with(F.slice("c", F.lit(1), F.size("c") - 1), F.slice("c", F.lit(2), F.size("c") - 1), lambda a, b: (a - 1) * n + b - 1)).alias("p"))
    counts = {True: [0] * (n * n), False: [0] * (n * n)}
    for r in pairs.groupBy("random", "p").count().collect():  # 2 x 68 x 68 rows at most
        counts[r["random"]][r["p"]] = r["count"]

    def logs(c: list[int]) -> list[float]:
        return [math.log((c[i * n + j] + 0.5) / (sum(c[i * n : i * n + n]) + 0.5 * n)) for i in range(n) for j in range(n)]

    return [round(a - b, 3) for a, b in zip(logs(counts[True]), logs(counts[False]))]


def _spans(text: Column, pattern: str, kind: int) -> Column:
    """Leftmost matches that don't overlap, as structs (start, kind, end, found)."""
    gaps, found = F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    empty = F.array().cast("array<struct<start:int,kind:int,end:int,found:string>>")
    both = F.arrays_zip(gaps.alias("gap"), found.alias("found"))

    def step(s: Column, x: Column) -> Column:
        start = s["at"] + F.length(x["gap"])
        end = start + F.length(x["found"])
        span = F.struct(start.cast("int").alias("start"), F.lit(kind).alias("kind"), end.cast("int").alias("end"), x["found"].alias("found"))
        return F.struct(end.cast("int").alias("at"), F.concat(s["out"], F.array(span)).alias("out"))

    # of the gap after the last match there is no match
    folded = F.aggregate(F.filter(both, lambda x: x["found"].isNotNull()), F.struct(F.lit(0).alias("at"), empty.alias("out")), step)["out"]
    return F.when(text.rlike(pattern), folded).otherwise(empty)


def _ratio(table: list[float], text: Column) -> Column:
    n = len(ALPHABET)
    table = F.lit(table)
    start = F.struct(F.lit(0).alias("last"), F.lit(0.0).alias("sum"))

    def step(s: Column, c: Column) -> Column:
        return F.struct(c.alias("last"), (s["sum"] + F.when(s["last"] > 0, F.element_at(table, (s["last"] - 1) * n + c)).otherwise(0.0)).alias("sum"))

    return F.aggregate(_codes(text), start, step)["sum"]


#: Characters that a stretch within a run has at least.
STRETCH = 16


def _stretches(table: list[float], run: Column) -> Column:
    """The likely stretches of a run (start, kind, end, found), as such structs."""
    n = len(ALPHABET)
    table = F.lit(table)
    zero, none = F.lit(0.0), F.array().cast("array<struct<start:int,kind:int,end:int,found:string>>")
    text, first = run["found"], run["start"]

    def grown(s: Column) -> Column:
        size = s["top_at"] - s["begin"]
        ratio = s["top"] + LEAST_EACH * (size - 1)
        span = F.struct((first + s["begin"]).cast("int").alias("start"), F.lit(3).alias("kind"), (first + s["top_at"]).cast("int").alias("end"), F.substring(text, s["begin"] + 1, size).alias("found"))
        return F.when((size >= STRETCH) & (ratio >= F.greatest(F.lit(LEAST), LEAST_EACH * size)), F.concat(s["out"], F.array(span))).otherwise(s["out"])

    def state(at: Column, last: Column, begin: Column, sum_: Column, top: Column, top_at: Column, out: Column) -> Column:
        return F.struct(at.alias("at"), last.alias("last"), begin.alias("begin"), sum_.alias("sum"), top.alias("top"), top_at.alias("top_at"), out.alias("out"))

    def step(s: Column, c: Column) -> Column:
        now = s["sum"] + F.when(s["last"] > 0, F.element_at(table, (s["last"] - 1) * n + c) - LEAST_EACH).otherwise(0.0)
        at = s["at"] + 1
        fell = (s["last"] > 0) & ((now <= 0) | (s["top"] - now >= LEAST))
        fresh = state(at, c, s["at"], zero, zero, at, grown(s))
        return F.when(fell, fresh).otherwise(state(at, c, s["begin"], now, F.greatest(now, s["top"]), F.when(now > s["top"], at).otherwise(s["top_at"]), s["out"]))

    return F.aggregate(_codes(text), state(F.lit(0), F.lit(0), F.lit(0), zero, zero, F.lit(0), none), step, grown)


def _without(text: Column, spans: Column) -> Column:
    """The text with blanks in place of spans (sorted by start)."""
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out"))

    def step(s: Column, x: Column) -> Column:
        begin, end = F.greatest(s["at"], x["start"]), F.greatest(s["at"], x["end"])
        return F.struct(end.alias("at"), F.concat(s["out"], F.array(F.substring(text, s["at"] + 1, begin - s["at"]), F.repeat(F.lit(" "), end - begin))).alias("out"))

    cut = lambda s: F.concat(F.array_join(s["out"], ""), F.substring(text, s["at"] + 1, F.length(text)))
    return F.when(F.size(spans) == 0, text).otherwise(F.aggregate(spans, start, step, cut))


def _listed(spans: Column) -> Column:
    name = lambda k: F.element_at(F.lit(list(KINDS)), k + 1)
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", name(s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def scan(docs: DataFrame, table: list[float]) -> DataFrame:
    """Each row's doc_id, base spans and all spans, as arrays of (start, kind, end, found)."""
    text = F.col("t")
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("t"))
    kept = F.filter(_spans(text, ASSIGN, 0), lambda s: F.length(F.regexp_extract(s["found"], ASSIGN, 2)) >= 8)
    rows = rows.select("doc_id", "t", kept.alias("assign"), _spans(text, ACCESS, 1).alias("access"), _spans(text, HEX, 2).alias("hex"))
    rows = rows.select("doc_id", "t", F.array_sort(F.concat("assign", "access", "hex")).alias("base"))
    rows = rows.select("doc_id", "base", _without(text, F.col("base")).alias("t"))
    rows = rows.select("doc_id", "base", _spans(text, RUN, 3).alias("runs"))
    whole = lambda r: _ratio(table, r["found"]) >= F.greatest(F.lit(LEAST), LEAST_EACH * F.length(r["found"]))
    likely = F.flatten(F.transform("runs", lambda r: F.when(whole(r), F.array(r)).otherwise(_stretches(table, r))))
    return rows.select("doc_id", "base", F.array_sort(F.concat("base", likely)).alias("spans"))


def op10_markov_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan(spark.read.parquet(f"{sf_dir}/documents.parquet"), train(labelled(spark)))
    of = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long").alias(f"n_{KINDS[k]}")
    return found.select("doc_id", of(0), of(1), of(2), F.sha2(_listed(F.col("base")), 256).alias("base_sha256"), _listed(F.col("spans")).alias("spans"))


QUERIES = {"op10_markov_secrets": op10_markov_secrets}
