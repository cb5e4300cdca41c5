"""TF-IDF over words and word pairs, and mini-batch k-means over sparse vectors."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ventura.operators.joins import top_per_key
from ventura.session import shared_dir, ship

#: English words that carry no topic.
STOP = tuple(
    "a about above after again all also am an and any are as at be because been before being below between both but by can could did do does doing down during each few for from further had has have having he her here hers "
    "him his how i if in into is it its itself just me more most my no nor not now of off on once only or other our out over own same she should so some such than that the their them then there these they this those "
    "through to too under until up very was we were what when where which while who whom why will with would you your".split()
)
#: Rows of a mini-batch, steps, and rows on which the first centres are chosen, of so many tries the best.
BATCH, STEPS, FIRST_ROWS, TRIES = 2048, 20, 6144, 5
#: Rows a task compares with all centres at a time.
CHUNK = 256
#: Counters of hashed terms, words whose terms a task holds at a time, and terms it adds up before it hands them on.
COUNTERS, WORDS, TERMS = 1 << 20, 1 << 17, 200_000


def words(text: Column, stop: tuple[str, ...] = STOP) -> Column:
    """Words of two word characters and more but stop words."""
    return F.filter(F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"(?U)\b(\w\w+)\b"), 1), lambda w: ~w.isin(*stop))


def _documents(docs: DataFrame, id_col: str, text_col: str, carried: tuple[str, ...]) -> DataFrame:
    """id, words (an empty one behind each text), and arrays of the carried columns; rows with equal ids are one document.

    One pass over the ids alone tells whether any is in several rows; if none is, no text is shuffled.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.concat(words(F.col(text_col)), F.array(F.lit(""))).alias("words"), *carried)
    if docs.groupBy(id_col).agg(F.count("*").alias("rows")).filter("rows > 1").isEmpty():
        return rows.select("id", "words", *(F.array(c).alias(c) for c in carried))
    return rows.groupBy("id").agg(F.flatten(F.collect_list("words")).alias("words"), *(F.collect_list(c).alias(c) for c in carried))


def _terms(batch: pa.RecordBatch) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """First row and row behind the last, and row and term of all words and pairs of neighbours in them, WORDS words at a time."""
    lists = batch.column(batch.schema.get_field_index("words"))
    ends = lists.offsets.to_numpy() - lists.offsets[0].as_py()
    flat, low = lists.flatten(), 0
    while low < len(lists):
        high = max(low + 1, int(np.searchsorted(ends, ends[low] + WORDS, "right")) - 1)
        w = flat.slice(ends[low], ends[high] - ends[low]).to_numpy(zero_copy_only=False)
        row = np.repeat(np.arange(low, high), np.diff(ends[low : high + 1]))
        there = w != ""
        pair = there[:-1] & there[1:]
        yield low, high, np.concatenate([row[there], row[:-1][pair]]), np.concatenate([w[there], w[:-1][pair] + (" " + w[1:][pair])])
        low = high


def _slots(terms: np.ndarray) -> np.ndarray:
    return (pd.util.hash_array(terms, categorize=False) % COUNTERS).astype(np.int64)


def _slot_totals(rows: DataFrame) -> np.ndarray:
    """Occurrences by hash values of terms: tasks count in tables of COUNTERS numbers, and at most as many rows come to the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros(COUNTERS, np.int64)
        for batch in batches:
            for *_, terms in _terms(batch):
                n += np.bincount(_slots(terms), minlength=COUNTERS)
        there = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(there), pa.array(n[there])], ["slot", "n"])

    found = rows.select("words").mapInArrow(run, "slot long, n long").groupBy("slot").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(COUNTERS, np.int64)
    out[found["slot"].to_numpy()] = found["n"].to_numpy()
    return out


def _counted(rows: DataFrame, wanted: np.ndarray) -> DataFrame:
    """term, df, total of all terms whose slot is wanted; tasks add up before the shuffle, in tables of at most TERMS terms."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, list[int]] = {}
        made = lambda: pa.RecordBatch.from_arrays([pa.array(list(sums), pa.string()), *(pa.array([v[k] for v in sums.values()], pa.int64()) for k in (0, 1))], ["term", "df", "total"])
        for batch in batches:
            for low, _, row, terms in _terms(batch):
                keep = wanted[_slots(terms)]
                code, names = pd.factorize(terms[keep])
                key, tf = np.unique((row[keep] - low) * len(names) + code, return_counts=True)
                code = key % max(len(names), 1)
                for name, df, total in zip(names, np.bincount(code).tolist(), np.bincount(code, tf).astype(np.int64).tolist()):
                    had = sums.setdefault(name, [0, 0])
                    had[0] += df
                    had[1] += total
                if len(sums) > TERMS:
                    yield made()
                    sums.clear()
        yield made()

    return rows.select("words").mapInArrow(run, "term string, df long, total long").groupBy("term").agg(F.sum("df").alias("df"), F.sum("total").alias("total"))


def _vocabulary(rows: DataFrame, n: int, features: int, min_df: int, max_df: float) -> dict[str, int]:
    """df of the terms of the vocabulary, in their order.

    Only terms in slots of at least ``least`` occurrences are counted one by one: another term has fewer. So the ``features`` most
    occurring ones are found when the last of them has ``least`` or more, or when ``least`` is so low that it keeps out none.
    """
    totals = _slot_totals(rows)
    floor, most = max(min_df, 1), min(3 * features // 2, COUNTERS)
    least = max(floor, int(np.partition(totals, COUNTERS - most)[COUNTERS - most]))
    while True:
        fit = _counted(rows, totals >= least).filter((F.col("df") >= min_df) & (F.col("df") <= max_df * n))
        found = fit.orderBy(F.desc("total"), "term").limit(features).collect()
        full = len(found) == features
        if least <= floor or full and found[-1]["total"] >= least:
            return {r["term"]: r["df"] for r in sorted(found, key=lambda r: r["term"])}
        least = max(floor, found[-1]["total"] if full else least // 16)


def tf_idf_vectors(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", features: int = 8000, min_df: int = 8, max_df: float = 0.35, carried: tuple[str, ...] = ()) -> tuple[DataFrame, list[str]]:
    """id, at, x (places and values of a sparse vector), arrays of the carried columns; and the terms by place.

    Values are (1 + ln tf) * (1 + ln((1 + n) / (1 + df))), each document's of length 1. The vocabulary is the ``features`` terms of the
    most occurrences (ties: the smaller term) in at least ``min_df`` documents and at most the share ``max_df`` of them. It goes through
    the driver to all tasks, and is bounded by ``features``. Documents without such a term have no row; rows with equal ids are
    one document. A document's terms are counted where it stands: its vector is made without a shuffle.
    """
    ship(docs.sparkSession)
    rows = _documents(docs, id_col, text_col, carried)
    n = docs.agg(F.count_distinct(id_col)).first()[0]
    df = _vocabulary(rows, n, features, min_df, max_df)
    vocabulary, idf = list(df), 1 + np.log((1 + n) / (1 + np.array(list(df.values()), np.float64)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = pd.Index(vocabulary, dtype=object)
        for batch in batches:
            for low, high, row, terms in _terms(batch):
                place = index.get_indexer(pd.Index(terms, dtype=object))
                known = place >= 0
                key, tf = np.unique((row[known] - low) * max(len(index), 1) + place[known], return_counts=True)
                row, place = np.divmod(key, max(len(index), 1))
                x = (1 + np.log(tf)) * idf[place]
                x /= np.sqrt(np.bincount(row, x * x, high - low))[row]
                size = np.bincount(row, minlength=high - low)
                met = np.flatnonzero(size)
                ends = pa.array(np.concatenate([[0], np.cumsum(size[met])]).astype(np.int32))
                kept = batch.take(pa.array(low + met))
                arrays = [kept.column("id"), pa.ListArray.from_arrays(ends, pa.array(place.astype(np.int32))), pa.ListArray.from_arrays(ends, pa.array(x)), *(kept.column(c) for c in carried)]
                yield pa.RecordBatch.from_arrays(arrays, ["id", "at", "x", *carried])

    kinds = "".join(f", {c} array<{docs.schema[c].dataType.simpleString()}>" for c in carried)
    return rows.mapInArrow(run, f"id {docs.schema[id_col].dataType.simpleString()}, at array<int>, x array<double>{kinds}"), vocabulary


def tf_idf(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", features: int = 8000, min_df: int = 8, max_df: float = 0.35, carried: tuple[str, ...] = ()) -> DataFrame:
    """id, term, weight, and arrays of the carried columns: a row for each entry of ``tf_idf_vectors``."""
    vectors, vocabulary = tf_idf_vectors(docs, id_col, text_col, features, min_df, max_df, carried)
    places = docs.sparkSession.createDataFrame(list(enumerate(vocabulary)), "place int, term string")
    entries = vectors.select("id", *carried, F.explode(F.arrays_zip("at", "x")).alias("e")).select("id", *carried, F.col("e.at").alias("place"), F.col("e.x").alias("weight"))
    return entries.join(F.broadcast(places), "place").select(F.col("id").alias(id_col), "term", "weight", *carried)


def dense_vectors(rows: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """id, at, x of vectors brought to length 1; zero vectors stay."""
    x = F.transform(vector_col, lambda v: v.cast("double"))
    norm = F.sqrt(F.aggregate(x, F.lit(0.0), lambda s, v: s + v * v))
    unit = F.transform(x, lambda v: F.coalesce(F.try_divide(v, norm), F.lit(0.0)))
    return rows.select(F.col(id_col).alias("id"), F.transform(unit, lambda v, i: i).alias("at"), unit.alias("x"))


def _flat(at: list, x: list) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places, values and row numbers of sparse rows, end to end."""
    size = np.fromiter(map(len, at), np.int64, len(at))
    whole = lambda parts, kind: np.concatenate([np.asarray(p, kind) for p in parts]) if len(parts) else np.zeros(0, kind)
    return whole(at, np.int64), whole(x, np.float64), np.repeat(np.arange(len(at)), size)


def _distances(at: np.ndarray, x: np.ndarray, row: np.ndarray, n: int, centres: np.ndarray) -> np.ndarray:
    """Squared distances of n sparse rows to all centres."""
    dense = np.zeros((n, centres.shape[1]))
    dense[row, at] = x
    return np.maximum(np.einsum("ij,ij->i", dense, dense)[:, None] + np.einsum("ij,ij->i", centres, centres)[None] - 2 * dense @ centres.T, 0)


def _nearest(batch: pd.DataFrame, centres: np.ndarray) -> Iterator[tuple[pd.DataFrame, np.ndarray, np.ndarray]]:
    for k in range(0, len(batch), CHUNK):
        part = batch.iloc[k : k + CHUNK]
        d = _distances(*_flat(list(part["at"]), list(part["x"])), len(part), centres)
        best = d.argmin(axis=1)
        yield part, best, d[np.arange(len(part)), best]


def assign(vectors: DataFrame, centres: np.ndarray) -> DataFrame:
    """id, cluster, distance (squared) of every row; of equally near centres the first."""
    ship(vectors.sparkSession)
    kind = vectors.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for part, best, d in _nearest(batch, centres):
                yield pd.DataFrame({"id": part["id"].to_numpy(), "cluster": best.astype("int32"), "distance": d})

    return vectors.select("id", "at", "x").mapInPandas(run, f"id {kind}, cluster int, distance double")


def _first_centres(at: list, x: list, k: int, dims: int, rng: np.random.Generator) -> np.ndarray:
    """k-means++ on the rows given: each next centre is, of some rows drawn by squared distance to the ones there are, the one that leaves least."""
    n = len(at)
    flat = _flat(at, x)
    own = np.bincount(flat[2], flat[1] ** 2, n)

    def to(row: int) -> np.ndarray:
        centre = np.zeros(dims)
        centre[at[row]] = x[row]
        return np.maximum(own + own[row] - 2 * np.bincount(flat[2], flat[1] * centre[flat[0]], n), 0)

    best = None
    for _ in range(TRIES):
        chosen = [int(rng.integers(n))]
        near = to(chosen[0])
        while len(chosen) < k:
            total = near.sum()
            drawn = rng.choice(n, size=2 + int(np.log(k)), p=near / total) if total > 0 else rng.integers(n, size=1)
            kept = [np.minimum(near, to(int(row))) for row in drawn]
            least = int(np.argmin([d.sum() for d in kept]))
            chosen.append(int(drawn[least]))
            near = kept[least]
        if best is None or near.sum() < best[0]:
            best = near.sum(), chosen
    centres = np.zeros((k, dims))
    for c, row in enumerate(best[1]):
        centres[c, at[row]] = x[row]
    return centres


def minibatch_kmeans(vectors: DataFrame, k: int, dims: int, seed: int = 0, steps: int = STEPS, batch: int = BATCH) -> np.ndarray:
    """Centres after ``steps`` mini-batches of about ``batch`` rows of ``vectors`` (id, at, x), at most k.

    Rows are dealt to steps by a hash of id and seed, in one pass over the table, so runs are equal however the table is
    partitioned; in small tables a row is dealt several times. In each step tasks sum up the rows nearest to each centre, and a
    centre moves towards their mean by their share of all rows it ever had. Through the driver go only the centres, their sums, and
    FIRST_ROWS rows for the first ones.
    """
    spark = vectors.sparkSession
    ship(spark)
    vectors = vectors.select("id", "at", "x")
    n = vectors.count()
    if not n:
        return np.zeros((0, dims))
    hashed = lambda *more: F.pmod(F.xxhash64("id", *map(F.lit, more)), F.lit(1 << 30))
    chance = min(1.0, 1.5 * FIRST_ROWS / n)  # thins the table before the sort
    sample = vectors.withColumn("h", hashed(seed, "first")).filter(F.col("h") < int(chance * (1 << 30))).orderBy("h", "id").limit(FIRST_ROWS).collect()
    rng = np.random.default_rng(seed)
    centres = _first_centres([np.asarray(r["at"], np.int64) for r in sample], [np.asarray(r["x"]) for r in sample], min(k, len(sample)), dims, rng)

    times = steps * batch / n
    copies = F.lit(int(times)) + (hashed(seed, "more") < int((times - int(times)) * (1 << 30))).cast("int")
    dealt = vectors.withColumn("copy", F.explode(F.filter(F.sequence(F.lit(0), copies), lambda c: c > 0)))
    dealt = dealt.withColumn("step", F.pmod(F.xxhash64("id", "copy", F.lit(seed)), F.lit(steps)).cast("int"))
    folder = f"{shared_dir(spark)}/ventura-batches-{uuid.uuid4().hex}"
    dealt.select("at", "x", "step").repartition("step").write.partitionBy("step").parquet(folder)
    seen = np.zeros(len(centres))

    def sums(now: np.ndarray):
        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            total, count = np.zeros_like(now), np.zeros(len(now))
            for rows in batches:
                for part, best, _ in _nearest(rows, now):
                    at, x, row = _flat(list(part["at"]), list(part["x"]))
                    total += np.bincount(best[row] * now.shape[1] + at, x, now.size).reshape(now.shape)
                    count += np.bincount(best, minlength=len(now))
            there = np.flatnonzero(count)
            yield pd.DataFrame({"cluster": there, "n": count[there], "total": pd.Series(total[there].tolist(), dtype=object)})

        return run

    for step in range(steps):
        rows = spark.read.schema("at array<int>, x array<double>, step int").parquet(folder).filter(F.col("step") == step)  # one folder
        found = rows.select("at", "x").mapInPandas(sums(centres), "cluster long, n double, total array<double>").collect()
        for r in sorted(found, key=lambda r: (r["cluster"], r["n"])):
            c = r["cluster"]
            seen[c] += r["n"]
            centres[c] += (np.asarray(r["total"]) - r["n"] * centres[c]) / seen[c]
    return centres


def representatives(assigned: DataFrame, count: int = 8) -> DataFrame:
    """The rows nearest to each cluster's centre."""
    return top_per_key(assigned, ["cluster"], [F.col("distance"), F.col("id")], count)


def text_clusters(docs: DataFrame, k: int = 50, features: int = 8000, min_df: int = 8, max_df: float = 0.35, seed: int = 0) -> DataFrame:
    """id, cluster, distance of all documents that have a term of the vocabulary."""
    vectors, vocabulary = tf_idf_vectors(docs, features=features, min_df=min_df, max_df=max_df)
    path = f"{shared_dir(docs.sparkSession)}/ventura-vectors-{uuid.uuid4().hex}"
    vectors.write.parquet(path)  # read several times below
    vectors = docs.sparkSession.read.parquet(path)
    return assign(vectors, minibatch_kmeans(vectors, k, len(vocabulary), seed))
