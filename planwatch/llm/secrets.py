"""Secret scans with multipart credential linking, in DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from planwatch.llm.common import Numbered, documents, written

#: kind: pattern, the group whose length counts, its least length. A match that is too short is dropped, but scanning goes on behind it.
BASE = {
    "assign": (r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12),
    "access": (r"AKIA[A-Z0-9]+", 0, 18),
    "hex": (r"[0-9a-f]{16,}", 0, 16),  # runs of [0-9a-f] are maximal, so the shorter ones can go unmatched
}
#: Weak candidates, reported only beside a complementary part.
WEAK = {
    "user": (r"""(?i)(user_?name|user_?id|user|login|client_?id|account_?id)["']?\x20*[:=]\x20*["']?([A-Za-z0-9_.@+-]+)""", 2, 3),
    "opaque": (r"(?<![A-Za-z0-9+/_-])(?=[A-Za-z+/_-]*[0-9])(?=[0-9+/_-]*[A-Za-z])[A-Za-z0-9+/_-]{20,}={0,2}", 0, 20),  # with a letter and a digit
    "endpoint": (r"""(?i)(https?|ftp|postgres(?:ql)?|mysql|mongodb|redis|amqp|jdbc:[a-z0-9]+)://[^\x20\x09-\x0D"'<>]+""", 0, 10),
}
KINDS = [*BASE, *WEAK]
SCOPE = 400  # code points between the starts of parts that belong together
IDENTIFIERS, SECRETS = ("access", "user"), ("assign", "hex", "opaque")


def _matches(text: Column, pattern: str, group: int, least: int) -> Column:
    """For a text with a match: array of (code points before it since the last match, its length, whether it counts). Where the group whose length
    counts is the whole match, matches are taken once."""
    hit = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    gaps = F.transform(F.split(text, pattern, -1), F.length)
    sizes = F.transform(hit, F.length)
    counts = F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(group)) if group else hit, lambda x: F.length(x) >= least)
    return F.when(text.rlike(pattern), F.arrays_zip(F.slice(gaps, F.lit(1), F.size(sizes)).alias("gap"), sizes.alias("size"), counts.alias("ok")))


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", scope: int = SCOPE) -> DataFrame:
    """(doc_id, text_key, length, spans) for each row of ``docs``; text_key and length (in code points) tell the text.

    spans is an array of (start, place, end, kind) in order of start, then of kind as listed in KINDS; start and end are code points,
    end exclusive. Strong spans are those of BASE. Weak ones count within ``scope`` code points (between starts) of what
    completes them: a user name beside a secret, an opaque string beside an identifier, an endpoint beside both. An opaque
    string that overlaps a strong span is that span and isn't reported again. Null and empty texts have no spans
    (null counts as empty). Repeated rows get the same spans each.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.xxhash64(text).alias("text_key"), F.length(text).cast("bigint").alias("length"), text.alias("text"))
    found = {kind: _matches(F.col("text"), *spec) for kind, spec in (BASE | WEAK).items()}
    rows = written(rows.select("doc_id", "text_key", "length", *[c.alias(k) for k, c in found.items()]), "secret-matches")

    key = ["doc_id", "text_key", "length"]
    hits = rows.where(" or ".join(f"{k} is not null" for k in KINDS)).dropDuplicates(key)
    one = hits.select(*key, F.explode(F.array(*[F.struct(F.lit(i).alias("place"), F.lit(k).alias("kind"), F.col(k).alias("m")) for i, k in enumerate(KINDS)])).alias("e")).select(*key, "e.*")
    one = one.select(*key, "place", "kind", F.posexplode("m").alias("i", "x"))
    end = F.sum(F.col("x.gap") + F.col("x.size")).over(W.partitionBy(*key, "kind").orderBy("i"))
    spans = one.withColumn("end", end.cast("bigint")).where("x.ok").select(*key, (F.col("end") - F.col("x.size")).alias("start"), "place", "end", "kind", F.floor((F.col("end") - F.col("x.size")) / scope).alias("cell"))

    # The interval join: parts lie in cells as long as the scope, a weak candidate looks into its own and both beside it.
    w = spans.where(F.col("kind").isin(*WEAK)).withColumn("near", F.explode(F.array(F.col("cell") - 1, "cell", F.col("cell") + 1))).alias("w")
    p = spans.alias("p")
    meets = [F.col(f"w.{c}").eqNullSafe(F.col(f"p.{c}")) for c in key] + [F.col("w.near") == F.col("p.cell"), F.abs(F.col("w.start") - F.col("p.start")) <= scope]
    on = meets[0]
    for c in meets[1:]:
        on = on & c
    overlap = (F.col("w.start") < F.col("p.end")) & (F.col("p.start") < F.col("w.end"))
    apart = ~overlap
    linked = w.join(p, on).groupBy(*[F.col(f"w.{c}") for c in (*key, "start", "place", "end", "kind")]).agg(
        F.bool_or(apart & F.col("p.kind").isin(*IDENTIFIERS)).alias("identifier"),
        F.bool_or(apart & F.col("p.kind").isin(*SECRETS)).alias("secret"),
        F.bool_or(overlap & F.col("p.kind").isin(*BASE)).alias("known"),
    )
    complete = ((F.col("kind") == "user") & F.col("secret")) | ((F.col("kind") == "opaque") & F.col("identifier") & ~F.col("known")) | ((F.col("kind") == "endpoint") & F.col("identifier") & F.col("secret"))
    columns = [*key, "start", "place", "end", "kind"]
    kept = spans.where(F.col("kind").isin(*BASE)).select(*columns).unionByName(linked.where(complete).select(*columns))
    of = kept.groupBy(*key).agg(F.array_sort(F.collect_list(F.struct("start", "place", "end", "kind"))).alias("spans")).alias("s")
    r = rows.select(*key).alias("r")
    same = F.col("r.doc_id").eqNullSafe(F.col("s.doc_id")) & (F.col("r.text_key") == F.col("s.text_key")) & (F.col("r.length") == F.col("s.length"))
    none = F.array().cast("array<struct<start:bigint,place:int,end:bigint,kind:string>>")
    return r.join(of, same, "left").select("r.doc_id", "r.text_key", "r.length", F.coalesce("spans", none).alias("spans"))


def _joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def op10_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contract's columns over all documents, as ``scan`` says it for nulls, empty texts and repeated rows."""
    strong = F.filter("spans", lambda s: s["place"] < len(BASE))
    n = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("bigint").alias(f"n_{kind}")
    return scan(documents(spark, sf_dir)).select("doc_id", n("assign"), n("access"), n("hex"), F.sha2(_joined(strong).cast("binary"), 256).alias("base_sha256"), _joined(F.col("spans")).alias("spans"))


def without_secrets(docs: DataFrame) -> DataFrame:
    """Pipeline stage: every row stays; each span found becomes ``<kind>``, overlapping ones together the kind of the first.

    n_chars is counted anew where a text changed. Rows without a span, null and empty texts included, stay as they are, and so do other
    columns, whatever their names. Repeated rows are masked alike; an empty table gives no rows.
    """
    own = Numbered(docs)
    doc_id, text, n_chars = (F.col(own.of(c)) for c in ("doc_id", "text", "n_chars"))
    whole = F.coalesce(text.cast("string"), F.lit(""))
    found = scan(own.rows, own.of("doc_id"), own.of("text")).where(F.size("spans") > 0).dropDuplicates(["doc_id", "text_key", "length"])
    same = doc_id.cast("bigint").eqNullSafe(F.col("doc_id")) & (F.xxhash64(whole) == F.col("text_key")) & (F.length(whole) == F.col("length"))
    joined = own.rows.join(found, same, "left")
    # Spans to text: what lies between the last one and this, then the mask.
    one = lambda s, end, kind: F.struct(s["start"].alias("start"), end.alias("end"), kind.alias("kind"))
    merged = F.aggregate(
        "spans",
        F.array().cast("array<struct<start:bigint,end:bigint,kind:string>>"),
        lambda done, s: F.when((F.size(done) == 0) | (s["start"] >= F.element_at(F.when(F.size(done) > 0, done), -1)["end"]), F.concat(done, F.array(one(s, s["end"], s["kind"])))).otherwise(
            F.concat(F.slice(done, F.lit(1), F.size(done) - 1), F.array(one(F.element_at(F.when(F.size(done) > 0, done), -1), F.greatest(s["end"], F.element_at(F.when(F.size(done) > 0, done), -1)["end"]), F.element_at(F.when(F.size(done) > 0, done), -1)["kind"])))
        ),
    )
    joined = joined.withColumn("merged", merged)
    before = lambda i: F.when(i == 0, F.lit(0)).otherwise(F.get(F.col("merged"), i - 1)["end"])
    pieces = F.transform("merged", lambda s, i: F.concat(F.substring(text, (before(i) + 1).cast("int"), (s["start"] - before(i)).cast("int")), F.lit("<"), s["kind"], F.lit(">")))
    tail = F.substr(text, (F.element_at("merged", -1)["end"] + 1).cast("int"))
    masked = joined.withColumn("masked", F.when(F.col("merged").isNotNull(), F.concat(F.array_join(pieces, ""), tail)))
    return own.named(masked.withColumns({own.of("text"): F.coalesce("masked", text), own.of("n_chars"): F.when(F.col("masked").isNull(), n_chars).otherwise(F.length("masked")).cast(docs.schema["n_chars"].dataType)}))
