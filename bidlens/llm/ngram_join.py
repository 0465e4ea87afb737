"""N-gram Jaccard self-join of documents.

Exact: rare-first prefix filtering with length, positional and suffix filters.

Plan, for ``num/den`` the Jaccard threshold:

1. One pass over the texts hashes each document's distinct n-grams to 64 bits and
   signs the whole set with 128 bits.  Equal sets form a class; one member stands for it.
2. A cheap exact screen: under hash order the (n - t + l)-prefixes of two linked sets
   share at least l grams, so a class with too few prefix grams that any other class
   has in its own prefix cannot link.  Grams that meet inside one Arrow batch are
   combined there, so a gram of a huge group of copies sends few rows to the shuffle.
3. For the classes left, gram frequencies are counted over all of them and each set is
   put in rare-first order; grams that only one class has come first and need no index.
4. The prefix index is joined in turns.  First each entry meets one hub of its
   (gram, length band) bucket, which connects groups of near copies in linear
   size; then entries whose components still differ meet a few hubs, and at last each
   other.  Length and positional filters are conditions of all joins; in the later turns
   so is a lower bound of the symmetric difference, from parities of hashed grams.
5. Every candidate pair is verified once: suffix filter, then exact intersection.  A link
   between two components is kept as that pair of components, once, whatever the number of links.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import by_ids, connected_components, documents, join_sized, materialize, release, text_rows

_MIX = np.uint64(0x9E3779B97F4A7C15)
_SHIFT = np.uint64(29)
#: Entries of the per-task caches; they only save time.
_CACHE = 200_000
#: Times that entries of different components meet a hub before they meet each other.
HUB_TURNS = 3
#: Hubs of a bucket in such a turn: large components that few of their pairs link are found apart less often.
HUBS = 8
#: Parity words of a set, of 64 bits each.
PARITIES = 8
#: Entries of a (gram, bucket) group that one task compares with the group; larger groups are split.
GROUP = 500


def _grams(text: str | None, n: int, cache: dict) -> np.ndarray:
    """Sorted distinct hashes of the n-word grams; a shorter text is one gram; no words, none."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.empty(0, np.uint64)
    if len(cache) > _CACHE:
        cache.clear()
    hashes = np.empty(len(words), np.uint64)
    for i, w in enumerate(words):
        v = cache.get(w)
        if v is None:
            v = cache[w] = xxhash.xxh64_intdigest(w)
        hashes[i] = v
    k = min(n, len(words))
    m = len(words) - k + 1
    x = np.full(m, k, np.uint64)
    for i in range(k):
        x = (x ^ hashes[i : i + m]) * _MIX
        x ^= x >> _SHIFT
    return np.unique(x)


def _signature(x: np.ndarray) -> tuple[int, int]:
    digest = xxhash.xxh3_128_digest(x.tobytes())
    return int.from_bytes(digest[:8], "little", signed=True), int.from_bytes(digest[8:], "little", signed=True)


def _lists(arrays: list[np.ndarray]) -> pa.ListArray:
    offsets = np.zeros(len(arrays) + 1, np.int32)
    np.cumsum([len(a) for a in arrays], out=offsets[1:])
    values = np.concatenate(arrays) if arrays else np.empty(0, np.uint64)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values.astype(np.uint64).view(np.int64)))


def _screen_pass(n: int, num: int, den: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache: dict = {}
        seen: set = set()
        none = np.empty(0, np.uint64)
        for batch in batches:
            ids = batch.column(0).to_pylist()
            size, hi, lo, prefixes = [], [], [], []
            for text in batch.column(1).to_pylist():
                x = _grams(text, n, cache)
                digest = _signature(x)
                size.append(len(x))
                hi.append(digest[0])
                lo.append(digest[1])
                if len(x) == 0 or digest in seen:
                    prefixes.append(None)
                    continue
                if len(seen) > _CACHE:
                    seen.clear()
                seen.add(digest)
                t = -(-num * len(x) // den)
                prefixes.append(x[: len(x) - t + max(1, len(x) // 8)])
            own = [p for p in prefixes if p is not None]
            if own:
                values, counts = np.unique(np.concatenate(own), return_counts=True)
                multi = values[counts > 1]
            else:
                multi = none
            kinds, local, grams = [], [], []
            for p in prefixes:
                if p is None:
                    kinds.append(0), local.append(0), grams.append(none)
                else:
                    met = np.isin(p, multi, assume_unique=True)
                    kinds.append(1), local.append(int(met.sum())), grams.append(p[~met])
            columns = [
                pa.array([*ids, None], pa.int64()),
                pa.array([*kinds, 2], pa.int32()),
                pa.array([*size, 0], pa.int64()),
                pa.array([*hi, None], pa.int64()),
                pa.array([*lo, None], pa.int64()),
                pa.array([*local, 0], pa.int64()),
                _lists([*grams, multi]),
            ]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "kind", "n", "hi", "lo", "local", "grams"])

    return run


def _set_pass(n: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache: dict = {}
        for batch in batches:
            sets = [_grams(t, n, cache) for t in batch.column(1).to_pylist()]
            names = [_signature(x)[1] for x in sets]
            odd = [np.packbits(np.bincount((x % np.uint64(64 * PARITIES)).astype(np.int64), minlength=64 * PARITIES) & 1).view(np.uint64) for x in sets]
            columns = [pa.array(names, pa.int64()), pa.array([len(x) for x in sets], pa.int64()), _lists(sets), _lists(odd)]
            yield pa.RecordBatch.from_arrays(columns, ["doc", "n", "grams", "odd"])

    return run


def _rank(freq: np.ndarray, gram: np.ndarray, f: int, g: int) -> int:
    """Entries of a (frequency, gram) ordered set that lie before (f, g)."""
    a, b = np.searchsorted(freq, f, "left"), np.searchsorted(freq, f, "right")
    return int(a + np.searchsorted(gram[a:b], g, "left"))


def _least_hamming(fa, ga, fb, gb, depth: int) -> int:
    """Lower bound of the symmetric difference: split both sets at a middle gram and compare sizes, twice."""
    if depth == 0 or len(ga) == 0 or len(gb) == 0:
        return abs(len(ga) - len(gb))
    mid = len(gb) // 2
    f, g = fb[mid], gb[mid]
    i = _rank(fa, ga, f, g)
    same = i < len(ga) and fa[i] == f and ga[i] == g
    left = _least_hamming(fa[:i], ga[:i], fb[:mid], gb[:mid], depth - 1)
    right = _least_hamming(fa[i + same :], ga[i + same :], fb[mid + 1 :], gb[mid + 1 :], depth - 1)
    return left + right + (not same)


def linked(na: int, fa, ga, nb: int, fb, gb, num: int, den: int) -> bool:
    """Whether two sets, given by their shared grams in rare-first order, reach num/den Jaccard."""
    needed = -(-num * (na + nb) // (num + den))
    shared_most = len(ga) + len(gb) - _least_hamming(fa, ga, fb, gb, 3)
    if shared_most < 2 * needed:
        return False
    both = len(np.intersect1d(ga, gb, assume_unique=True))
    return den * both >= num * (na + nb - both)


def _verify_pass(num: int, den: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            t = {k: batch.column(i) for i, k in enumerate(batch.schema.names)}
            a, b, na, nb = (t[k].to_pylist() for k in ("ca", "cb", "na", "nb"))

            def cut(name):
                c = t[name]
                o, v = c.offsets.to_numpy(), c.values.to_numpy(zero_copy_only=False)
                return [v[o[i] : o[i + 1]] for i in range(len(c))]

            fa, ga, fb, gb = cut("fa"), cut("ga"), cut("fb"), cut("gb")
            keep = [i for i in range(len(a)) if linked(na[i], fa[i], ga[i], nb[i], fb[i], gb[i], num, den)]
            yield pa.RecordBatch.from_arrays([pa.array([a[i] for i in keep], pa.int64()), pa.array([b[i] for i in keep], pa.int64())], ["src", "dst"])

    return run


def _verified(pairs: DataFrame, sets: DataFrame, num: int, den: int) -> DataFrame:
    """The components (ca, cb) of those pairs (a, b) that link."""
    one = sets.select(F.col("doc").alias("a"), F.col("n").alias("na"), F.col("freqs").alias("fa"), F.col("grams").alias("ga"))
    two = sets.select(F.col("doc").alias("b"), F.col("n").alias("nb"), F.col("freqs").alias("fb"), F.col("grams").alias("gb"))
    met = pairs.join(one, "a").join(two, "b").select("ca", "cb", "na", "nb", "fa", "ga", "fb", "gb")
    return met.mapInArrow(_verify_pass(num, den), "src long, dst long")


def _components(docs: DataFrame, id_col: str, text_col: str, n: int, num: int, den: int) -> DataFrame:
    """doc_id, lo (name of its set), n_shingles, root (name of the component), component_id, class_size; a table."""
    texts = text_rows(docs, id_col, text_col)
    base = materialize(
        texts.mapInArrow(_screen_pass(n, num, den), "doc_id long, kind int, n long, hi long, lo long, local long, grams array<long>"), "screen"
    )
    rows = base.where("kind < 2").select("doc_id", "n", "hi", "lo", "kind", "local")
    # A batch combines the grams that meet in it, so a gram has about one row a batch here, however common it is.
    per_gram = Window.partitionBy("gram")
    shared = (
        base.where("kind > 0")
        .select(F.explode("grams").alias("gram"), "lo")
        .select("lo", F.min("lo").over(per_gram).alias("least"), F.max("lo").over(per_gram).alias("most"), F.max(F.col("lo").isNull()).over(per_gram).alias("multi"))
        .where("lo is not null and (multi or least <> most)")
        .groupBy("lo")
        .agg(F.count("*").alias("met"))
    )
    classes = materialize(
        rows.where("n > 0 and doc_id is not null")
        .groupBy("hi", "lo")
        .agg(F.min("doc_id").alias("rep"), F.first("n").alias("n"), F.count("*").alias("class_size")),
        "classes",
    )
    sent = rows.where("n > 0").groupBy("hi", "lo").agg(F.sum("local").alias("local"), F.sum(F.when(F.col("kind") == 1, 1).otherwise(0)).alias("times"))
    need = f"greatest(1, cast(floor(ceil({num} * n / {den}) / 8) as long))"
    chosen = materialize(
        classes.join(sent, ["hi", "lo"])
        .join(shared, "lo", "left")
        .where(f"local + coalesce(met, 0) >= times * {need}")
        .select(F.col("rep").alias("doc_id"), "lo"),
        "chosen",
    )

    # One row stands for each class.  Where ids repeat, the signature tells the texts apart.
    small = by_ids(texts, chosen.select("doc_id").distinct(), "doc_id", "left_semi")
    read = small.mapInArrow(_set_pass(n), "doc long, n long, grams array<long>, odd array<long>")
    if rows.groupBy("doc_id").count().where("count > 1").limit(1).count():
        read = read.join(chosen.select(F.col("lo").alias("doc")).distinct(), "doc", "left_semi").dropDuplicates(["doc"])
    full = materialize(read, "sets")
    index = full.select("doc", F.explode("grams").alias("gram"))
    freq = materialize(index.groupBy("gram").agg(F.count("*").cast("int").alias("f")).where("f > 1"), "freq")
    total = full.agg(F.coalesce(F.sum(F.size("grams")), F.lit(0))).first()[0]
    prefix = f"(n - cast(ceil({num} * n / {den}) as long) + 1)"
    sets = materialize(
        join_sized(index, freq, ["gram"], "f", total)
        .groupBy("doc")
        .agg(F.sort_array(F.collect_list(F.struct("f", "gram"))).alias("g"))
        .join(full.select("doc", "n", "odd"), "doc")
        .where(f"n - size(g) < {prefix}")
        .select("doc", "n", "odd", F.col("g.f").alias("freqs"), F.col("g.gram").alias("grams")),
        "ordered",
    )
    entries = materialize(
        sets.select(
            "doc",
            "n",
            F.floor(F.log("n") / F.log(F.lit(den / num + 1e-4))).cast("int").alias("band"),
            (F.col("n") - F.size("grams")).alias("alone"),
            F.posexplode(F.expr(f"slice(grams, 1, cast({prefix} - n + size(grams) as int))")).alias("at", "gram"),
        ).select("doc", "n", "band", "gram", (F.col("alone") + F.col("at")).alias("pos")),
        "prefix",
    )
    release(full, freq)
    roots = _joined(entries, sets, num, den)
    release(entries, sets)

    # Nodes are named by their set's signature; a component by its smallest document id.
    joined = classes.join(roots.withColumnRenamed("node", "lo"), "lo", "left").withColumn("root", F.coalesce("root", "lo"))
    smallest = joined.groupBy("root").agg(F.min("rep").alias("component_id"))
    named = materialize(joined.join(smallest, "root").where("class_size > 1 or component_id <> rep").select("hi", "lo", "root", "component_id", "class_size"), "named")
    # Rows of one set meet its name, and a set may have a third of all rows: the few such sets are broadcast, and empty sets have no name.
    empty = F.col("n") == 0
    bound = max(1, rows.count() // 5_000)
    hot = F.broadcast(named.where(F.col("class_size") >= bound))
    met = rows.where(~empty).join(hot, ["hi", "lo"])
    rest = rows.where(~empty).join(hot.select("hi", "lo"), ["hi", "lo"], "left_anti").join(named.where(F.col("class_size") < bound), ["hi", "lo"], "left")
    out = met.unionByName(rest).unionByName(rows.where(empty), allowMissingColumns=True).select(
        "doc_id",
        "lo",
        F.col("n").alias("n_shingles"),
        F.coalesce("root", "lo").alias("root"),
        F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id")).alias("component_id"),
        F.coalesce("class_size", F.lit(1)).alias("class_size"),
    )
    out = materialize(out, "components")
    release(base, classes, chosen, roots, named)
    return out


def _joined(entries: DataFrame, sets: DataFrame, num: int, den: int) -> DataFrame:
    """(node, root) of the sets that links join, as :func:`connected_components` gives them."""
    fits = (
        f"{den} * least(a.n, b.n) >= {num} * greatest(a.n, b.n)"
        f" and {num + den} * (1 + least(a.n - a.pos - 1, b.n - b.pos - 1)) >= {num} * (a.n + b.n)"
    )
    apart = " + ".join(f"bit_count(a.odd[{i}] ^ b.odd[{i}])" for i in range(PARITIES))
    near = f"{num + den} * (a.n + b.n - ({apart})) >= {2 * num} * (a.n + b.n)"
    wide = entries.select("*", F.explode(F.array("band", F.col("band") + 1)).alias("bucket"))
    hubs = entries.groupBy("gram", F.col("band").alias("bucket")).agg(F.min(F.struct("doc", "n", "pos")).alias("h"))
    sizes = wide.groupBy("gram", "bucket").agg(F.count("*").alias("entries")).where("entries > 1")
    hubs = materialize(hubs.join(sizes, ["gram", "bucket"]).select("gram", "bucket", "entries", F.col("h.doc").alias("hub"), F.col("h.n").alias("hub_n"), F.col("h.pos").alias("hub_pos")), "hubs")
    total = 2 * entries.count()
    first = fits.replace("b.n", "hub_n").replace("b.pos", "hub_pos").replace("a.", "")
    tried = materialize(
        join_sized(wide, hubs, ["gram", "bucket"], "entries", total)
        .where(f"doc <> hub and {first}")
        .select(F.least("doc", "hub").alias("a"), F.greatest("doc", "hub").alias("b"))
        .distinct(),
        "tried",
    )
    roots = connected_components(_verified(tried.select("*", F.col("a").alias("ca"), F.col("b").alias("cb")), sets, num, den), "stars")
    release(hubs)

    # Entries whose components still differ meet again: first a few hubs a bucket, chosen anew each time, so
    # that what is left of a group of near copies joins up in linear size; then each other.
    turn = 0
    while turn <= HUB_TURNS:
        of = wide.join(roots.withColumnRenamed("node", "doc"), "doc", "left").withColumn("comp", F.coalesce("root", "doc")).drop("root")
        of = materialize(of, "labelled")
        mixed = of.groupBy("gram", "bucket").agg(F.min("comp").alias("x"), F.max("comp").alias("y"), F.count("*").alias("entries")).where("x <> y")
        mixed = materialize(mixed.select("gram", "bucket", "entries"), "mixed")
        left = join_sized(of, mixed, ["gram", "bucket"], "entries", total).join(sets.select("doc", "odd"), "doc")
        left = materialize(left.withColumn("parts", (F.col("entries") / GROUP).cast("int") + 1), "left")
        release(of, mixed)
        if not left.limit(1).count():
            release(left)
            break
        other = left.where("band = bucket")
        if turn < HUB_TURNS:
            picks = [F.min_by(F.struct("doc", "n", "pos", "band", "comp", "odd", "parts"), F.xxhash64("doc", "gram", F.lit(turn * HUBS + i))) for i in range(HUBS)]
            other = other.groupBy("gram", "bucket").agg(F.array_distinct(F.array(*picks)).alias("h")).select("gram", "bucket", F.explode("h").alias("h")).select("gram", "bucket", "h.*")
        # A large group is split by entry; the other side goes to each part.
        dealt = left.withColumn("part", F.expr("pmod(xxhash64(doc), parts)"))
        copied = other.withColumn("part", F.explode(F.expr("sequence(0L, cast(parts - 1 as long))")))
        met = (
            dealt.alias("a").join(copied.alias("b"), ["gram", "bucket", "part"])
            .where(f"a.comp <> b.comp and (a.band < b.band or {'a.doc < b.doc' if turn == HUB_TURNS else 'true'}) and {fits} and {near}")
            .select(F.least("a.doc", "b.doc").alias("a"), F.greatest("a.doc", "b.doc").alias("b"), F.least("a.comp", "b.comp").alias("ca"), F.greatest("a.comp", "b.comp").alias("cb"))
            .distinct()
            .join(tried, ["a", "b"], "left_anti")
        )
        met = materialize(met, "met")
        new = connected_components(_verified(met, sets, num, den), "links")
        found = new.limit(1).count() > 0
        if found:
            grown = roots.join(new.select(F.col("node").alias("root"), F.col("root").alias("up")), "root", "left").select("node", F.coalesce("up", "root").alias("root"))
            grown = materialize(grown.unionByName(new), "roots")
            release(roots)
            roots = grown
        more = materialize(tried.unionByName(met.select("a", "b")), "tried")
        release(left, met, tried, new)
        tried = more
        turn = turn + 1 if found or turn == HUB_TURNS else HUB_TURNS
    release(tried)
    return roots


def ngram_jaccard_join(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", n: int = 5, num: int = 3, den: int = 4) -> DataFrame:
    """Connected components of the documents whose n-gram sets reach Jaccard num/den.

    Returns one row per input row: id, n_shingles, component_id (the smallest id that
    links reach) and class_size (rows with exactly the same set).  Words are maximal runs without ASCII
    white space, A-Z lowered.  Null or wordless texts have an empty set and stay alone.
    A null id links with nothing and has a null component.  Repeated ids are rows of
    their own.  Very long texts are read whole: a set is one array of 8 bytes a distinct n-gram.  An empty table gives an
    empty result.  Other columns, whatever their names, are not read.
    """
    return _components(docs, id_col, text_col, n, num, den).select("doc_id", "n_shingles", "component_id", "class_size")


def _named_pass(n: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache: dict = {}
        for batch in batches:
            texts = batch.column(1).to_pylist()
            names = [_signature(_grams(t, n, cache))[1] for t in texts]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(names, pa.int64())], ["doc_id", "text", "lo"])

    return run


def keep_one_of_each(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", n: int = 5, num: int = 3, den: int = 4) -> DataFrame:
    """docs without the documents that a smaller id reaches; the row with the smallest id of a component stays.

    Rows with a null id stay, as do null and wordless texts with an id of their own.  Rows that repeat an id are judged each by its own
    text; of those in one component with the smallest id, the one with the smallest text digest stays.  An empty table stays empty.
    Columns of any name and type that Parquet holds pass unchanged.
    """
    found = _components(docs, id_col, text_col, n, num, den)
    gone = materialize(found.where("component_id < doc_id").select(F.col("doc_id").alias(id_col)).distinct(), "gone")
    again = materialize(found.where("doc_id is not null").groupBy("doc_id").count().where("count > 1").select(F.col("doc_id").alias(id_col)), "again")
    if not again.limit(1).count():
        return by_ids(docs, gone, id_col, "left_anti")
    # Ids that repeat: one (id, text) a component, named by the set of its text.
    texts = text_rows(by_ids(docs, again, id_col, "left_semi"), id_col, text_col).distinct()
    verdict = found.select("doc_id", "lo", "root", "component_id", "n_shingles").distinct()
    first = Window.partitionBy("doc_id", "root", "alone").orderBy("digest")
    kept = (
        texts.mapInArrow(_named_pass(n), "doc_id long, text string, lo long")
        .join(verdict, ["doc_id", "lo"])
        .where("component_id = doc_id")
        .select("doc_id", "root", "n_shingles", F.sha2(F.coalesce("text", F.lit("")), 256).alias("digest"))
        .withColumn("alone", F.when(F.col("n_shingles") == 0, F.col("digest")))
        .select("doc_id", "digest", F.row_number().over(first).alias("place"))
        .where("place = 1")
        .select(F.col("doc_id").alias("kept_id"), F.col("digest").alias("kept_digest"))
    )
    digest = F.sha2(F.coalesce(F.col(text_col), F.lit("")), 256)
    held = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("held")
    rows = by_ids(docs, again, id_col, "left_semi").select(held, F.col(id_col).alias("kept_id"), digest.alias("kept_digest"))
    once = rows.groupBy("kept_id", "kept_digest").agg(F.first("held").alias("held")).join(kept, ["kept_id", "kept_digest"], "left_semi")
    single = by_ids(by_ids(docs, again, id_col, "left_anti"), gone, id_col, "left_anti")
    return single.unionByName(once.select("held.*"))


def op1_ngram_jaccard_join(spark, sf_dir: str) -> DataFrame:
    """Query: components of documents at five words and Jaccard 0.75."""
    return ngram_jaccard_join(documents(spark, sf_dir))
