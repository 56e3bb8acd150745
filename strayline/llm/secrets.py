"""Secret scans that weigh each candidate by who owns it across the corpus."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strayline.lineage import cut
from strayline.llm.rows import whole_text
from strayline.operators.skew import salted_join

#: kind, pattern, group of the secret itself, shortest secret. The order is the
#: order of kinds at one place; the last kind is the one ownership decides on.
KINDS = (
    (
        "assign",
        r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
        2,
        8,
    ),
    ("access", r"(AKIA[A-Z0-9]+)", 1, 16),
    ("hex", r"([0-9a-f]+)", 1, 32),
    ("opaque", r"([A-Za-z0-9_+/=-]{20,})", 1, 20),
)
#: What lets the scan of a kind skip a text: it has no match that is long enough.
MAY_HOLD = {"hex": r"[0-9a-f]{32}", "access": r"AKIA[A-Z0-9]{12}"}
BASE = 3
#: A secret that more owners hold is a widely copied example.
MOST_OWNERS = 2


def _found(text: Column, number: int) -> Column:
    """``kind, nth, gap, long, secret`` of every match, in the order of the text.

    The pieces between the matches come from a split by the same pattern, so
    piece i stands before match i; running sums of both lengths give places.
    """
    name, pattern, group, _ = KINDS[number]
    matches = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    secrets = F.regexp_extract_all(text, F.lit(pattern), F.lit(group))
    pieces = F.split(text, pattern, -1)
    spans = F.transform(
        F.arrays_zip(matches.alias("m"), secrets.alias("s"), pieces.alias("p")),
        lambda x, i: F.struct(
            F.lit(number).alias("kind"),
            i.alias("nth"),
            F.length(x["p"]).alias("gap"),
            F.length(x["m"]).alias("long"),
            x["s"].alias("secret"),
        ),
    )
    spans = F.filter(spans, lambda x: x["long"].isNotNull())
    none = F.filter(spans, lambda _: F.lit(False))
    return F.when(text.rlike(MAY_HOLD.get(name, pattern)), spans).otherwise(none)


def _mixed(secret: Column) -> Column:
    """Looks drawn at random: a digit, a capital and a small letter."""
    return secret.rlike("[0-9]") & secret.rlike("[A-Z]") & secret.rlike("[a-z]")


def ownership(candidates: DataFrame) -> DataFrame:
    """``print, owners, repositories`` per candidate, from ``print, owner, repository``.

    A repository counts once for each owner it has. Distinct triples are combined
    first and counted in two steps, so a candidate that a third of the corpus
    holds is never gathered in one task.
    """
    return (
        candidates.select("print", "owner", "repository")
        .distinct()
        .groupBy("print", "owner")
        .agg(F.count(F.lit(1)).alias("n"))
        .groupBy("print")
        .agg(F.count(F.lit(1)).alias("owners"), F.sum("n").alias("repositories"))
    )


def secret_spans(
    docs: DataFrame,
    id_col: str = "doc_id",
    text: str = "text",
    owner: str = "source",
    repository: str | None = None,
    most_owners: int = MOST_OWNERS,
) -> tuple[DataFrame, DataFrame]:
    """All rows as ``_row, <id>`` and all spans as ``_row, kind, start, end, live``.

    Base kinds are found by pattern alone. Other long tokens that look drawn at
    random and touch no base span are candidates, too. Every candidate is known by
    the SHA-256 of its secret. One that few owners and few repositories hold is
    ``live``; one that is copied widely is an example from a manual. Base spans
    stay either way, other candidates are spans only if live. Places count code
    points, the end is exclusive. A NULL text is empty, a NULL owner is an owner.
    """
    whole = whole_text(text)
    scanned = cut(
        docs.select(
            F.monotonically_increasing_id().alias("_row"),
            F.col(id_col),
            F.col(owner).cast("string").alias("_owner"),
            (F.sha2(whole, 256) if repository is None else F.col(repository).cast("string")).alias("_repository"),
            F.concat(*[_found(whole, k) for k in range(len(KINDS))]).alias("_found"),
        )
    )
    exploded = scanned.select("_row", "_owner", "_repository", F.explode("_found").alias("f")).select(
        "_row", "_owner", "_repository", "f.*"
    )
    so_far = Window.partitionBy("_row", "kind").orderBy("nth")
    shortest = F.element_at(F.array(*[F.lit(k[3]) for k in KINDS]), F.col("kind") + 1)
    placed = (
        exploded.withColumn("end", F.sum(F.col("gap") + F.col("long")).over(so_far))
        .withColumn("start", F.col("end") - F.col("long"))
        .filter(
            (F.length("secret") >= shortest)
            & ((F.col("kind") < BASE) | _mixed(F.col("secret")))
        )
        .withColumn("print", F.sha2("secret", 256))
    )
    by_place = Window.partitionBy("_row").orderBy("start", "kind")
    base = F.col("kind") < BASE
    before = F.max(F.when(base, F.col("end"))).over(by_place)
    after = F.min(F.when(base, F.col("start"))).over(by_place.rowsBetween(0, Window.unboundedFollowing))
    apart = (F.coalesce(before, F.lit(0)) <= F.col("start")) & (F.coalesce(after, F.col("end")) >= F.col("end"))
    candidates = cut(
        placed.withColumn("apart", apart)
        .filter(base | F.col("apart"))
        .select("_row", "kind", "start", "end", "print", F.col("_owner").alias("owner"), F.col("_repository").alias("repository"))
    )
    owned = ownership(candidates)
    spans = (
        salted_join(candidates, owned, ["print"], ["_row"])
        .withColumn("live", F.col("owners") <= most_owners)
        .filter(base | F.col("live"))
        .select("_row", "kind", "start", "end", "live")
    )
    return scanned.select("_row", id_col), spans


def scan_documents(docs: DataFrame, id_col: str = "doc_id", **options) -> DataFrame:
    """``id, n_assign, n_access, n_hex, base_sha256, spans, n_live, n_copied`` for every row.

    Spans are ``kind:start:end`` by start, then kind, joined by commas; the digest
    is that of the base spans alone. Rows are told apart even where ids repeat,
    texts without a span have zeros and empty strings.
    """
    rows, spans = secret_spans(docs, id_col, **options)
    names = F.array(*[F.lit(k[0]) for k in KINDS])
    text_of = lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"], s["end"])
    listed = spans.groupBy("_row").agg(
        F.sort_array(F.collect_list(F.struct("start", "kind", "end"))).alias("all"),
        *[F.count(F.when(F.col("kind") == k, 1)).alias(f"n_{KINDS[k][0]}") for k in range(BASE)],
        F.count(F.when(F.col("live"), 1)).alias("n_live"),
        F.count(F.when(~F.col("live"), 1)).alias("n_copied"),
    )
    none = F.array().cast("array<struct<start:bigint,kind:int,end:bigint>>")
    every = F.coalesce(F.col("all"), none)
    counts = [*[f"n_{KINDS[k][0]}" for k in range(BASE)], "n_live", "n_copied"]
    joined = lambda s: F.concat_ws(",", F.transform(s, text_of))
    counted = {c: F.coalesce(F.col(c), F.lit(0)).alias(c) for c in counts}
    return rows.join(listed, "_row", "left").select(
        id_col,
        *[counted[c] for c in counts[:BASE]],
        F.sha2(joined(F.filter(every, lambda s: s["kind"] < BASE)), 256).alias("base_sha256"),
        joined(every).alias("spans"),
        *[counted[c] for c in counts[BASE:]],
    )
