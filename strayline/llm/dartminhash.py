"""Near copies by DartMinHash signatures, banded joins and exact checks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strayline.lineage import cut
from strayline.llm.rows import keep_rows, whole_text
from strayline.llm.tokens import mix, slices, words
from strayline.operators.skew import salted_join

SHINGLE = 5
SIMILAR = 0.8
#: Two sets of similarity 0.8 share a band with probability 1 - (1 - 0.8^8)^50 =
#: 0.9999, sets of similarity 0.4 with 0.03.
BANDS, BAND_SIZE = 50, 8
SLICE_BYTES = 1 << 20
#: In a bucket of so few sets each is compared with each; a larger one is compared
#: with one leader after the other.
SMALL_BUCKET = 8
MORE_LEADERS = 8
#: Sets of a bucket that meet its leaders in one task; a class of so many rows is hot.
SPLIT_BUCKET = 256
HOT_CLASS = 100_000
#: Shingles of the partners that one task compares with one set at a time.
COMPARED = 1 << 21
#: Bits of the map that bounds what two sets can share, in words of 64.
BITMAP_WORDS = 16
#: Widths of the first and of the widest bands of ranks.
NARROWEST, WIDEST = 2.0**-10, 256.0


def shingles(texts: pa.Array, width: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """The different shingles of each text, sorted, and how many it has.

    A text with fewer words than a shingle has one shingle of all its words; one
    without words has none.
    """
    found, counts = words(texts)
    n = np.where(counts > 0, np.maximum(counts - width + 1, 1), 0)
    heads = np.cumsum(counts) - counts
    owner = np.repeat(np.arange(len(counts)), n)
    place = np.arange(len(owner)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(heads, n)
    last = np.repeat(heads + counts, n)
    key = np.zeros(len(owner), np.uint64)
    for k in range(width):
        at = place + k
        inside = at < last
        key = np.where(inside, mix(key * np.uint64(3) + found[np.minimum(at, max(len(found) - 1, 0))] + np.uint64(k)), key)
    order = np.lexsort((key, owner))
    key, owner = key[order], owner[order]
    first = np.ones(len(key), bool)
    first[1:] = (key[1:] != key[:-1]) | (owner[1:] != owner[:-1])
    return key[first], np.bincount(owner[first], minlength=len(counts)).astype(np.int64)


def darts(keys: np.ndarray, owner: np.ndarray, sizes: np.ndarray, coordinates: int, weights: np.ndarray | None = None, seed: int = 1) -> np.ndarray:
    """DartMinHash signatures, ``coordinates`` numbers per set.

    Darts fall on an element's region, its weight times an axis of ranks, at one
    dart per unit of area, and each belongs to one coordinate. Which darts there
    are hangs on the element, the cell of the region and the seed alone, so sets
    share the darts of what they share. A set looks at ranks, low ones first, until every
    coordinate has a dart, which takes about ``k ln k`` darts whatever the set's
    size, and keeps the earliest of each coordinate. Equal earliest darts in two sets
    are as likely as their weighted Jaccard similarity.

    Regions are cut along the weight at whole numbers and along the rank into
    bands that double in width up to ``WIDEST``. A cell's darts are drawn from a
    Poisson law. Ranks rise from band to band, so a coordinate that has a dart is
    closed.
    """
    weights = np.ones(len(keys)) if weights is None else weights
    total = np.bincount(owner, weights=weights, minlength=len(sizes))
    name = np.zeros((len(sizes), coordinates), np.uint64)
    filled = np.zeros((len(sizes), coordinates), bool)
    open_ = total > 0
    low, band = 0.0, 0
    while open_.any():
        use = np.flatnonzero(open_[owner])
        width = min(NARROWEST * 2.0 ** max(band - 1, 0), WIDEST)
        _throw(keys[use], owner[use], weights[use], low, width, band, coordinates, seed, filled, name)
        low, band = low + width, band + 1
        open_ &= ~filled.all(axis=1)
    return name


def _throw(keys, owner, weights, low, width, band, coordinates, seed, filled, name) -> None:
    """The darts of one band of ranks on the given elements."""
    columns = np.ceil(weights).astype(np.int64)
    element = np.repeat(np.arange(len(keys)), columns)
    column = np.arange(len(element)) - np.repeat(np.cumsum(columns) - columns, columns)
    cell = mix(mix(keys[element] + np.uint64(seed)) + np.uint64(band << 32) + column.astype(np.uint64))
    count = _poisson(_unit(mix(cell + np.uint64(1))), width)
    dart = np.repeat(np.arange(len(cell)), count)
    if not len(dart):
        return
    nth = (np.arange(len(dart)) - np.repeat(np.cumsum(count) - count, count)).astype(np.uint64)
    drawn = mix(cell[dart] + (nth + np.uint64(2)) * np.uint64(0x9E3779B97F4A7C15))
    coordinate = ((mix(drawn + np.uint64(4)) >> np.uint64(33)) % np.uint64(coordinates)).astype(np.int64)
    place = owner[element[dart]] * coordinates + coordinate
    flat = filled.reshape(-1)
    open_ = np.flatnonzero(~flat[place] & (column[dart] + _unit(drawn) < weights[element[dart]]))
    place, drawn = place[open_], drawn[open_]
    # Within a band the rank is a hash of the dart; only its order counts.
    order = np.lexsort((mix(drawn + np.uint64(3)), place))
    place, drawn = place[order], drawn[order]
    first = np.ones(len(place), bool)
    first[1:] = place[1:] != place[:-1]
    name.reshape(-1)[place[first]] = drawn[first]
    flat[place[first]] = True


def _unit(x: np.ndarray) -> np.ndarray:
    return (x >> np.uint64(11)) * 2.0**-53


def _poisson(u: np.ndarray, mean: float) -> np.ndarray:
    """Poisson numbers from uniform ones, by the inverse of the distribution."""
    cdf, term, k = [], np.exp(-mean), 0
    if mean > 500:
        raise ValueError("cells are too large")
    total = term
    while total < 1 - 1e-15 and k < mean + 60 * (1 + mean**0.5):
        cdf.append(total)
        k += 1
        term *= mean / k
        total += term
    return np.searchsorted(np.array(cdf or [1.0]), u, "right")


def signatures(keys: np.ndarray, sizes: np.ndarray, bands: int = BANDS, size: int = BAND_SIZE) -> np.ndarray:
    """One number per set and band."""
    owner = np.repeat(np.arange(len(sizes)), sizes)
    name = darts(keys, owner, sizes, bands * size).reshape(len(sizes), bands, size)
    out = np.broadcast_to(np.arange(bands, dtype=np.uint64), (len(sizes), bands)).copy()
    for k in range(size):
        out = mix(out * np.uint64(3) + name[:, :, k])
    return out


def _sketched(docs: DataFrame, id_col: str, text: str) -> DataFrame:
    """``_row, _id, _sha, _print, n, a, b, bands``: a set's size, two prints of it, its bands."""
    kind = dict(docs.dtypes)[id_col]
    whole = whole_text(text)
    narrow = docs.select(
        F.monotonically_increasing_id().alias("_row"),
        F.col(id_col).alias("_id"),
        F.sha2(whole, 256).alias("_sha"),
        F.xxhash64(whole).alias("_print"),
        whole.alias("text"),
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in slices(batches, SLICE_BYTES):
            table = table.combine_chunks()
            keys, sizes = shingles(table.column("text").combine_chunks())
            ends = np.concatenate(([0], np.cumsum(sizes)))
            prints = []
            for salt in (1, 2):
                running = np.concatenate(([np.uint64(0)], np.cumsum(mix(keys + np.uint64(salt)), dtype=np.uint64)))
                prints.append((running[ends[1:]] - running[ends[:-1]]).view(np.int64))
            bands = signatures(keys, sizes).view(np.int64)
            yield pa.RecordBatch.from_arrays(
                [table.column(c).combine_chunks() for c in ("_row", "_id", "_sha", "_print")]
                + [pa.array(sizes), *map(pa.array, prints)]
                + [pa.ListArray.from_arrays(np.arange(0, bands.size + 1, bands.shape[1], dtype=np.int32), pa.array(bands.ravel()))],
                ["_row", "_id", "_sha", "_print", "n", "a", "b", "bands"],
            )

    return narrow.mapInArrow(run, f"_row long, _id {kind}, _sha string, _print long, n long, a long, b long, bands array<long>")


def bitmaps(keys: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """``BITMAP_WORDS`` numbers per set: each shingle sets the bit that its hash names."""
    place = mix(keys + np.uint64(5)) % np.uint64(64 * BITMAP_WORDS)
    owner = np.repeat(np.arange(len(sizes)), sizes)
    flat = np.zeros(len(sizes) * BITMAP_WORDS, np.uint64)
    word = owner * BITMAP_WORDS + (place >> np.uint64(6)).astype(np.int64)
    np.bitwise_or.at(flat, word, np.uint64(1) << (place & np.uint64(63)))
    return flat.view(np.int64)


def _missing(own: str, other: str) -> Column:
    """Bits of one map that the other lacks: so many shingles at least are not shared."""
    return F.expr(" + ".join(f"bit_count({own}[{i}] & ~{other}[{i}])" for i in range(BITMAP_WORDS)))


def _sets(docs: DataFrame, wanted: DataFrame, id_col: str, text: str) -> DataFrame:
    """``set, keys, bits``: the shingles of the rows that are wanted, by id and print of the text."""
    whole = whole_text(text)
    rows = docs.select(F.col(id_col).alias("_own"), F.xxhash64(whole).alias("_mine"), whole.alias("text"))
    same = rows["_own"].eqNullSafe(wanted["_id"]) & (rows["_mine"] == wanted["_print"])
    rows = rows.join(wanted, same).select("set", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in slices(batches, SLICE_BYTES):
            table = table.combine_chunks()
            keys, sizes = shingles(table.column("text").combine_chunks())
            ends = np.concatenate(([0], np.cumsum(sizes)))
            lists = pa.ListArray.from_arrays(ends.astype(np.int32), pa.array(keys.view(np.int64)))
            starts = np.arange(0, len(sizes) * BITMAP_WORDS + 1, BITMAP_WORDS, dtype=np.int32)
            maps = pa.ListArray.from_arrays(starts, pa.array(bitmaps(keys, sizes)))
            yield pa.RecordBatch.from_arrays([table.column("set").combine_chunks(), lists, maps], ["set", "keys", "bits"])

    return rows.mapInArrow(run, "set long, keys array<long>, bits array<long>")


def _similarities(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """``x, y, nx, ny, same``: the pairs and how many shingles their sets share.

    Pairs are gathered by x in groups of about ``COMPARED`` shingles, so a leader with
    a great many partners is many groups; its set goes once to each.
    """
    sized = pairs.groupBy("x").agg(F.greatest(F.ceil(F.sum("ny") / COMPARED), F.lit(1)).cast("int").alias("parts"))
    leaders = sized.select("x", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
    left = pairs.join(sized, "x").select("x", "y", "nx", "ny", F.pmod(F.xxhash64("y"), "parts").cast("int").alias("part"))
    left = left.join(sets.select(F.col("set").alias("y"), "keys"), "y").select("x", "part", "y", "nx", "ny", "keys")
    right = leaders.join(sets.select(F.col("set").alias("x"), "keys"), "x")
    right = right.select(F.col("x").alias("own"), F.col("part").alias("own_part"), F.col("keys").alias("own_keys"))

    def run(members: pa.Table, leader: pa.Table) -> pa.Table:
        named = members.select(["x", "y", "nx", "ny"])
        if not members.num_rows:
            return named.append_column("same", pa.array([], pa.int64()))
        own, same = np.sort(leader.column("own_keys")[0].values.to_numpy()), []
        for data in members.column("keys"):
            other = np.sort(data.values.to_numpy())
            small, large = (own, other) if len(own) < len(other) else (other, own)
            at = np.searchsorted(large, small)
            same.append(int((large[np.minimum(at, len(large) - 1)] == small).sum()))
        return named.append_column("same", pa.array(same, pa.int64()))

    schema = "x long, y long, nx long, ny long, same long"
    return left.groupBy("x", "part").cogroup(right.groupBy("own", "own_part")).applyInArrow(run, schema)


def own_shingles(members: DataFrame, sets: DataFrame) -> DataFrame:
    """``set, alone``: how many shingles of a set no other set of ``members`` has.

    What two sets share is among the rest, which bounds their similarity.
    """
    active = members.select("set").distinct()
    return (
        sets.join(active, "set")
        .select("set", F.explode("keys").alias("key"))
        .groupBy("key")
        .agg(F.count(F.lit(1)).alias("n"), F.max("set").alias("set"))
        .filter("n = 1")
        .groupBy("set")
        .agg(F.count(F.lit(1)).alias("alone"))
    )


def merged(classes: DataFrame, links: DataFrame) -> DataFrame:
    """``set, class`` after the links: a class becomes the smallest it is linked to.

    Links between sets become links between classes. Then every class takes the
    smallest name of its neighbours and the name of that, until nothing changes;
    chains halve in each round. Links and names stay in tables.
    """
    ends = links.join(classes.withColumnsRenamed({"set": "x", "class": "a"}), "x").join(
        classes.withColumnsRenamed({"set": "y", "class": "b"}), "y"
    )
    ways = F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))
    both = cut(ends.filter("a != b").select(F.inline(ways)).distinct())
    names = None
    while True:
        if names is None:
            # At first every class has its own name, so that its neighbours' are in the links.
            least = both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("near")).withColumn("name", F.col("node"))
        else:
            least = both.join(names.withColumnsRenamed({"node": "b", "name": "near"}), "b").groupBy("a").agg(F.min("near").alias("near"))
            least = names.join(least, F.col("node") == F.col("a"))
        step = cut(least.select("node", "name", F.least("name", "near").alias("new")))
        # Pointer jumping: the name of the new name.
        jump = step.select(F.col("node").alias("at"), F.col("new").alias("next"))
        moved = cut(step.join(jump, F.col("new") == F.col("at")).select("node", F.least("new", "next").alias("new"), "name"))
        names = moved.select("node", F.col("new").alias("name"))
        if moved.filter("new != name").isEmpty():
            break
    renamed = classes.join(names, F.col("class") == F.col("node"), "left")
    return cut(renamed.select("set", F.coalesce("name", "class").alias("class")))


def classes_of(docs: DataFrame, sketched: DataFrame, id_col: str, text: str) -> DataFrame:
    """``set, class`` of the sets that share a band with another one.

    ``sketched`` has one row per different set. Sets that agree in a band are a
    bucket. Its leader is the set that meets most others over all its buckets, which
    in a group of edited copies is the text they were made from. It is compared
    with all others of the bucket that are not in its class and neither too small
    nor too large. Then classes are worked out, the leader leaves the bucket, and
    buckets that still hold more than one class go on, with ``MORE_LEADERS`` times as
    many leaders in each round. Each set of the bucket meets each of them, whichever
    ranks higher. So every link between two classes is found; a bucket whose sets
    have become one class is not paired off, and no pair is compared twice. From the
    second round on, sets are left out, and pairs not compared, that cannot reach
    the similarity because too many of their shingles are theirs alone: an edited
    copy that is near to nothing is not compared with all copies of its origin. Nor are
    pairs compared whose bitmaps differ in so many bits that they cannot be similar
    enough, such as copies of two origins that share a part.
    """
    in_bands = sketched.select(F.col("_row").alias("set"), "n", F.explode("bands").alias("bucket"))
    crowded = in_bands.groupBy("bucket").agg(F.count(F.lit(1)).alias("members")).filter("members > 1")
    met = cut(in_bands.join(crowded, "bucket").select("bucket", "set", "n", "members"))
    known = met.groupBy("set").agg(F.sum("members").alias("met"))
    wanted = cut(known.select("set"))
    named = sketched.select(F.col("_row").alias("set"), "_id", "_print").join(wanted, "set")
    sets = cut(_sets(docs, named, id_col, text))
    if sets.count() > wanted.count():  # rows that agree in id and text
        sets = cut(sets.dropDuplicates(["set"]))
    # One row per set; a bucket's rows name its sets and no more.
    about = cut(
        met.select("set", "n").distinct().join(known, "set").join(sets.select("set", "bits"), "set")
        .select("set", "n", F.col("n").alias("common"), F.struct("met", -F.col("set")).alias("rank"), "bits")
    )
    members = met.select("bucket", "set")
    classes = cut(wanted.select("set", F.col("set").alias("class")))
    tested = None
    rounds = 0
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    while True:
        if rounds:
            alone = own_shingles(members, sets)
            common = F.col("n") - F.coalesce("alone", F.lit(0))
            about = about.join(alone, "set", "left").withColumn("common", common).drop("alone")
            about = cut(about.filter(F.col("common") >= SIMILAR * F.col("n")))
        with_class = members.join(about.join(classes, "set"), "set")
        mixed = (
            with_class.groupBy("bucket")
            .agg(F.min("class").alias("least"), F.max("class").alias("most"), F.count(F.lit(1)).alias("members"))
            .filter("least < most")
            .select("bucket", "members", F.ceil(F.col("members") / SPLIT_BUCKET).cast("int").alias("splits"))
        )
        part = F.when(F.col("members") <= SMALL_BUCKET, F.col("set")).otherwise(F.pmod(F.xxhash64("set"), F.lit(MORE_LEADERS**rounds)))
        # A crowded bucket is split by set, so that no task gets all of it.
        split = F.pmod(F.xxhash64(F.lit(1), "set"), "splits").cast("int")
        active = cut(with_class.join(mixed, "bucket").withColumn("part", part).withColumn("split", split))
        leaders = active.groupBy("bucket", "part", "splits").agg(F.max(F.struct("rank", "set", "n", "class", "common", "bits")).alias("lead"))
        leaders = cut(leaders.select("bucket", "splits", F.col("lead.rank").alias("rx"), F.col("lead.set").alias("x"), F.col("lead.n").alias("nx"), F.col("lead.class").alias("cx"), F.col("lead.common").alias("sx"), F.col("lead.bits").alias("bx")))
        done = leaders.select("bucket", F.col("x").alias("set"))
        everywhere = leaders.withColumn("split", F.explode(F.sequence(F.lit(0), F.col("splits") - 1))).drop("splits")
        # Every set meets every leader of its bucket; two leaders meet once.
        active = cut(active.join(done.withColumn("leads", F.lit(True)), ["bucket", "set"], "left"))
        most = F.least("common", "sx")
        # What two sets must share, a hair less so that rounding rejects none.
        enough = (F.col("n") + F.col("nx")) * (SIMILAR / (1 + SIMILAR)) - 1e-6
        fits = (
            (F.col("class") != F.col("cx"))
            & (F.col("leads").isNull() | (F.col("rank") < F.col("rx")))
            & (F.least("n", "nx") >= SIMILAR * F.greatest("n", "nx"))
            & (most >= enough)
            & (F.col("n") - _missing("bits", "bx") >= enough)
            & (F.col("nx") - _missing("bx", "bits") >= enough)
        )
        # Few bytes but much work: a fixed number of partitions keeps it spread.
        # The higher rank is x in every bucket, so a pair has one name.
        above = F.col("rank") < F.col("rx")
        ends = {"x": ("x", "set"), "y": ("set", "x"), "nx": ("nx", "n"), "ny": ("n", "nx")}
        named_ends = [F.when(above, F.col(a)).otherwise(F.col(b)).alias(e) for e, (a, b) in ends.items()]
        pairs = active.repartition(parts, "bucket", "split").join(everywhere, ["bucket", "split"]).filter(fits).select(*named_ends)
        # The sizes hang on the pair; dealt out by its ends alone, it lies where those tested before do.
        pairs = pairs.dropDuplicates(["x", "y"])
        if tested is not None:
            pairs = pairs.join(tested, ["x", "y"], "left_anti")
        pairs = cut(pairs)
        same = F.col("same")
        linked = (same >= SIMILAR * (F.col("nx") + F.col("ny") - same)).alias("linked")
        found = cut(_similarities(pairs, sets).select("x", "y", linked))
        new = found.filter("linked").select("x", "y")
        if not new.isEmpty():
            classes = merged(classes, new)
        tested = found.select("x", "y") if tested is None else tested.union(found.select("x", "y"))
        # Leaders are done with their buckets, and all sets of small ones are leaders.
        members = cut(active.filter("leads IS NULL").select("bucket", "set"))
        if members.isEmpty():
            return classes
        rounds += 1


def near_classes(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """``id, class_id, class_size, kept, n_shingles`` for every row.

    Rows are in one class if a chain of links joins them, a link being a Jaccard
    similarity of at least ``SIMILAR`` between their sets of five-word shingles.
    Candidates come from bands of DartMinHash signatures and are checked on whole
    sets. The class's id is the smallest id in it and that row is kept; of rows
    that repeat it, one. A text of fewer than five words is one shingle. A text
    without words, NULL included, is like no other and a class of its own, as its
    id's row. A class's NULL id stands after all others. Rows with equal sets are
    one row from the start, however many they are. Texts are read whole however long, an
    empty table gives an empty one, and other columns are ignored whatever their names.
    """
    return _classes(docs, id_col, text).select(
        F.col("_id").alias(id_col), "class_id", "class_size", "kept", F.col("n").alias("n_shingles")
    )


def _classes(docs: DataFrame, id_col: str, text: str) -> DataFrame:
    sketched = cut(_sketched(docs, id_col, text))
    some = sketched.filter("n > 0")
    one = cut(some.groupBy("n", "a", "b").agg(F.min("_row").alias("_first")))
    firsts = one.select(F.col("_first").alias("_row"))
    different = cut(some.join(firsts, "_row", "left_semi").select("_row", "_id", "_print", "n", "bands"))
    classes = classes_of(docs, different, id_col, text)
    of_set = one.join(classes, F.col("_first") == F.col("set"), "left").select("n", "a", "b", F.coalesce("class", "_first").alias("class"))
    named = some.select("_row", "_id", "_sha", "n", "a", "b").join(of_set, ["n", "a", "b"]).select("_row", "_id", "_sha", "n", "class")
    alone = sketched.filter("n = 0").select("_row", "_id", "_sha", "n", F.col("_row").alias("class"))
    named = cut(named.union(alone))
    first = F.min(F.struct(F.col("_id").isNull().alias("none"), F.col("_id").alias("id"), F.col("_row").alias("row")))
    groups = cut(named.groupBy("class").agg(first.alias("_best"), F.count(F.lit(1)).alias("class_size")))
    hot = groups.filter(F.col("class_size") > HOT_CLASS).select("class", F.ceil(F.col("class_size") / HOT_CLASS).cast("int").alias("_parts"))
    return salted_join(named, groups, ["class"], ["_row"], hot=None if hot.isEmpty() else hot, counted=True).select(
        "_id", "_sha", "n", F.col("_best.id").alias("class_id"), "class_size", (F.col("_row") == F.col("_best.row")).alias("kept")
    )


def drop_near_copies(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """One row of ``docs`` per class, with all its columns.

    Rows are classed as ``near_classes`` does: texts without words, NULL included, stay,
    of rows that agree in id and text one stays, an empty table stays empty, and a column
    may have any name.
    """
    classes = cut(_classes(docs, id_col, text).select("_id", "_sha", "kept"))
    again = classes.groupBy("_id", "_sha").count().filter("count > 1")
    return keep_rows(docs, classes.filter("kept").select("_id", "_sha"), id_col, text, repeated=not again.isEmpty())
