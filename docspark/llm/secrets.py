"""Secret scan with multipart credential linking, in DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import cut, table, text_of

#: (kind, literal or pattern that any match needs, pattern, pattern of the part to measure or None, least length)
BASE = (
    (
        "assign",
        r"[:=]",
        r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
        r"""(?i)^(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)$""",
        8,
    ),
    ("access", "AKIA", r"AKIA[A-Z0-9]+", None, 16),
    # A run of hex digits is matched whole or not at all, so short runs can be passed over by the pattern itself.
    ("hex", None, r"[0-9a-f]{32,}", None, 32),
)
#: Parts that say little alone. A weak secret also needs a letter and a digit.
WEAK = (
    (
        "link_id",
        r"[:=]",
        r"""(?i)(?:access_?key_?id|client_?id|account_?id|key_?id|user_?name|user|login)["']?\x20*[:=]\x20*["']?[A-Za-z0-9_.@-]{3,}""",
    ),
    ("link_secret", None, r"[A-Za-z0-9+/_-]{20,}"),
    ("link_endpoint", r":", r"""(?:https?|jdbc:[a-z]+|postgres(?:ql)?|mysql|mongodb|redis|amqp|s3)://[^\x20\x09-\x0D"'<>]+"""),
)
KINDS = tuple(k[0] for k in BASE) + tuple(k[0] for k in WEAK)
#: Parts belong together if they start at most so many code points apart.
SCOPE = 200


def _found(text: Column, kind: str, needs: str | None, pattern: str, measured: str | None, least: int) -> Column:
    """The matches in order: kind, number, code points since the last match ended, code points, whether it counts."""
    gaps = F.split(text, pattern, -1)
    matches = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))

    def counts(m: Column) -> Column:
        if kind == "link_secret":
            return m.rlike("[0-9]") & m.rlike("[A-Za-z]")
        return F.length(F.regexp_extract(m, measured, 2) if measured else m) >= least

    each = F.transform(
        F.arrays_zip(matches.alias("m"), F.slice(gaps, F.lit(1), F.size(matches)).alias("g")),
        lambda z: F.struct(
            F.lit(kind).alias("kind"),
            F.length(z["g"]).alias("gap"),
            F.length(z["m"]).alias("len"),
            counts(z["m"]).alias("counts"),
        ),
    )
    has = text.rlike(pattern)
    if needs:
        has = (text.rlike(needs) if needs[0] == "[" else text.contains(needs)) & has
    return F.when(has, each).otherwise(F.array().cast("array<struct<kind:string,gap:int,len:int,counts:boolean>>"))


def _number(kind: Column) -> Column:
    return F.array_position(F.array(*[F.lit(k) for k in KINDS]), kind)


def _near(left: DataFrame, right: DataFrame, scope: int) -> DataFrame:
    """Interval semi-join: rows of left with a row of right in the same document at most ``scope`` away.

    Documents are cut into scopes; each right row is looked for in its own and the two beside it.
    """
    around = F.explode(F.array(*[(F.floor(F.col("start") / scope) + k) for k in (-1, 0, 1)]))
    r = right.select(F.col("rid").alias("r_rid"), F.col("start").alias("r_start"), around.alias("r_bin"))
    at = F.floor(left["start"] / scope)
    return left.join(
        r, (left["rid"] == r["r_rid"]) & (at == r["r_bin"]) & (F.abs(left["start"] - r["r_start"]) <= scope), "left_semi"
    )


def scan(docs: DataFrame, scope: int = SCOPE) -> DataFrame:
    """One row per input row: doc_id, spans array<struct<start, no, end, kind>> sorted by start, then kind.

    Base kinds are always reported. A weak secret is reported if an identifier (weak
    or an access key) starts within ``scope`` code points of it, a weak identifier if
    a secret (weak, assigned or hex) does, and an endpoint if both do. Parts inside a
    base span are left to that span. Null text counts as empty; rows that repeat a
    doc_id are scanned each for itself; an empty table gives an empty result.
    """
    found = docs.select(
        F.monotonically_increasing_id().alias("rid"), docs["doc_id"].cast("long").alias("doc_id"), text_of(docs).alias("text")
    ).select(
        "rid",
        "doc_id",
        *[_found(F.col("text"), *b).alias(b[0]) for b in BASE],
        *[_found(F.col("text"), w[0], w[1], w[2], None, 1).alias(w[0]) for w in WEAK],
    )
    # Written once: the row numbers must be the same wherever they are used below.
    found = cut(found)
    one = None
    for kind in KINDS:
        x = found.where(F.size(kind) > 0).select("rid", F.posexplode(kind).alias("i", "p"))
        one = x if one is None else one.unionAll(x)
    before = Window.partitionBy("rid", "kind").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    spans = one.select("rid", "i", "p.*").withColumn("end", F.sum(F.col("gap") + F.col("len")).over(before))
    spans = spans.where("counts").select(
        "rid", "kind", (F.col("end") - F.col("len")).alias("start"), "end", _number(F.col("kind")).alias("no")
    )
    spans = cut(spans)
    base = spans.where(F.col("no") <= len(BASE))
    # A weak part inside a base span: the last base span that starts at or before it reaches beyond its start.
    reach = Window.partitionBy("rid").orderBy("start", "no").rowsBetween(Window.unboundedPreceding, 0)
    free = (
        spans.withColumn("reach", F.max(F.when(F.col("no") <= len(BASE), F.col("end"))).over(reach))
        .where((F.col("no") > len(BASE)) & ((F.col("reach") <= F.col("start")) | F.col("reach").isNull()))
        .drop("reach")
    )
    free = cut(free)
    kind = F.col("kind")
    ids = base.where(kind == "access").unionByName(free.where(kind == "link_id"))
    keys = base.where(kind != "access").unionByName(free.where(kind == "link_secret"))
    linked = (
        _near(free.where(kind == "link_secret"), ids, scope)
        .unionByName(_near(free.where(kind == "link_id"), keys, scope))
        .unionByName(_near(_near(free.where(kind == "link_endpoint"), ids, scope), keys, scope))
    )
    per_doc = (
        base.unionByName(linked)
        .groupBy("rid")
        .agg(F.array_sort(F.collect_list(F.struct("start", "no", "end", "kind"))).alias("spans"))
    )
    none = F.array().cast("array<struct<start:bigint,no:bigint,end:bigint,kind:string>>")
    return found.select("rid", "doc_id").join(per_doc, "rid", "left").select("doc_id", F.coalesce("spans", none).alias("spans"))


def op5_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = scan(table(spark, sf_dir, "documents"))
    base = F.filter("spans", lambda s: s["no"] <= len(BASE))
    count = lambda k: F.size(F.filter("spans", lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    written = lambda a: F.concat_ws(
        ",", F.transform(a, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string")))
    )
    return out.select(
        "doc_id",
        *[count(b[0]) for b in BASE],
        F.sha2(written(base), 256).alias("base_sha256"),
        written(F.col("spans")).alias("spans"),
    )
