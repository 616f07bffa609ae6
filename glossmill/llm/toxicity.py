"""Severity grades of toxic text by a cumulative-link ordinal regression over sparse word features.

Grades are ordered: 0 not toxic, 1 toxic, 2 toxic and of low quality.  One
vector of weights is shared by both thresholds:
P(grade > k) = sigmoid(score - threshold k).  It is fitted on the driver from
a sample of labelled rows whose size is bounded by SAMPLE for each grade.

Features are a text's distinct words and the beginnings of these, so that
forms of a word that the sample lacks count too.  A feature is scaled by how
much oftener it stands in toxic documents than chance has it, and left out if
that is within NOISE standard deviations.
"""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import store

#: Labelled rows of each grade that the fit may use, those with the least hash of their id.
SAMPLE = 2500
#: Hashed words; the model has this many weights whatever the corpus.
BUCKETS = 1 << 18
GRADES = 3
#: Features, in all, of the labelled rows of each grade that the fit may use: rows come by the hash of their id, with all their features, up to this.  It bounds what the driver gets, by 370 MB.
ENTRIES = 10_240_000
#: Bytes of the beginnings of words; documents added to a feature's count as if at random; what passes for chance.
STEMS, PRIOR, NOISE = (4, 5, 6, 7), 3.0, 1.5
#: Words whose scores a task keeps at most.
MEMO = 100_000


def word_features(word: bytes) -> list[int]:
    """Indexes of a word and its beginnings."""
    from zlib import crc32

    return [crc32(word + b">") & (BUCKETS - 1), *(crc32(word[:k]) & (BUCKETS - 1) for k in STEMS if len(word) >= k)]


def words(data: bytes) -> set[bytes]:
    """The distinct words of a text, lower-cased in A-Z."""
    import re

    return set(re.findall(rb"[a-z\x80-\xff]+", data.lower()))


def features(data: bytes):
    """(indexes, counts) of the distinct features of the distinct words: as many of these as have the feature."""
    import numpy as np

    return np.unique(np.fromiter((k for w in words(data) for k in word_features(w)), np.int64), return_counts=True)


def scale(toxic, every, n_toxic: int, n: int):
    """The factor of each feature from the numbers of toxic and of all rows that have it; 0 for features that tell no more than chance."""
    import numpy as np

    chance = every * n_toxic / max(1, n)
    factor = np.log((PRIOR + toxic) / (PRIOR + chance))
    factor[np.abs(toxic - chance) < NOISE * np.sqrt(chance + 1)] = 0
    return factor


def fit(rows: list[tuple[int, object, object]], rounds: int = 300, penalty: float = 1e-3, rate: float = 0.1):
    """(weights, thresholds) from (grade, index, value) rows, by Adam on the penalised mean negative log-likelihood."""
    import numpy as np

    if not rows:
        return np.zeros(BUCKETS), np.array([30.0, 31.0])
    grade = np.array([r[0] for r in rows])
    index, value = np.concatenate([r[1] for r in rows]), np.concatenate([r[2] for r in rows])
    owner = np.repeat(np.arange(len(rows)), [len(r[1]) for r in rows])
    used, column = np.unique(index, return_inverse=True)
    above = np.array([(grade > k).sum() + 0.5 for k in range(GRADES - 1)]) / (len(rows) + 1)
    first = -np.log(above / (1 - above))
    gap = max(0.05, first[1] - first[0])
    x = np.concatenate([np.zeros(len(used)), [first[0], np.log(gap)]])
    m, v = np.zeros_like(x), np.zeros_like(x)
    sigmoid = lambda z: 1 / (1 + np.exp(-np.clip(z, -40, 40)))
    for step in range(1, rounds + 1):
        score = np.bincount(owner, x[column] * value, len(rows))
        low, high = x[-2], x[-2] + np.exp(x[-1])
        p0, p1 = sigmoid(low - score), sigmoid(high - score)  # P(grade <= k)
        chance = np.maximum(np.select([grade == 0, grade == 1], [p0, p1 - p0], 1 - p1), 1e-12)
        d0, d1 = p0 * (1 - p0), p1 * (1 - p1)
        by_low = np.select([grade == 0, grade == 1], [d0, -d0], 0) / chance
        by_high = np.select([grade == 1, grade == 2], [d1, -d1], 0) / chance
        pull = (by_low + by_high) / len(rows)  # of the score, on the loss
        slope = np.concatenate([np.bincount(column, pull[owner] * value, len(used)) + penalty * x[:-2], [-(by_low + by_high).mean(), -by_high.mean() * np.exp(x[-1])]])
        m, v = 0.9 * m + 0.1 * slope, 0.99 * v + 0.01 * slope**2
        x -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    weights = np.zeros(BUCKETS)
    weights[used] = x[:-2]
    return weights, np.array([x[-2], x[-2] + np.exp(x[-1])])


def train(docs: DataFrame, labels: DataFrame, id_column: str = "doc_id", text_column: str = "text", sample: int = SAMPLE):
    """Fit on labelled rows (id, toxic, quality); rows without a label, id or text are passed over.

    Rows that share an id count each for itself, with each of its labels.
    Other columns, whatever their names, are left out.  Without any toxic or
    any clean labels the model says what the labels say.
    """
    import numpy as np

    grade = F.when(F.col("toxic") == 0, 0).when(F.coalesce("quality", F.lit(1)) == 0, 2).otherwise(1)
    graded = labels.where(F.col("toxic").isNotNull() & F.col(id_column).isNotNull()).select(F.col(id_column).alias("labelled"), grade.alias("grade"))
    chosen = None
    for g in range(GRADES):
        part = graded.where(F.col("grade") == g).orderBy(F.xxhash64("labelled"), "labelled").limit(sample)
        chosen = part if chosen is None else chosen.union(part)

    def sparse(batches):
        import pyarrow as pa

        for batch in (whole.slice(at, 256) for whole in batches for at in range(0, whole.num_rows, 256)):
            rows = [features(x.as_py()) for x in batch.column(2).cast(pa.binary())]
            columns = [pa.array([r[k].astype(np.int32) for r in rows], pa.list_(pa.int32())) for k in range(2)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], *columns], ["grade", "turn", "at", "times"])

    texts = docs.select(store.column(id_column).alias("id"), store.column(text_column).alias("text")).where("text is not null")
    labelled = texts.join(F.broadcast(chosen), F.col("id") == F.col("labelled")).select("grade", F.xxhash64("labelled").alias("turn"), "text")  # at most GRADES * sample rows
    told = store.stage(labelled.mapInArrow(store.lean(sparse), "grade int, turn long, at array<int>, times array<int>"), "features")
    grades = {r["grade"]: r["n"] for r in told.groupBy("grade").agg(F.count(F.lit(1)).alias("n")).collect()}  # GRADES rows
    totals = told.select((F.col("grade") > 0).cast("int").alias("toxic"), F.explode("at").alias("k")).groupBy("k").agg(F.sum("toxic").alias("toxic"), F.count(F.lit(1)).alias("n")).toArrow()  # at most BUCKETS rows
    toxic, every, at = np.zeros(BUCKETS), np.zeros(BUCKETS), totals.column("k").to_numpy()
    toxic[at], every[at] = totals.column("toxic").to_numpy(), totals.column("n").to_numpy()
    factor = scale(toxic, every, sum(n for g, n in grades.items() if g), sum(grades.values()))
    shared = docs.sparkSession.sparkContext.broadcast(factor)

    def telling(batches):
        import pyarrow as pa

        for batch in (whole.slice(at, 256) for whole in batches for at in range(0, whole.num_rows, 256)):
            rows = []
            for at, times in zip(batch.column(2), batch.column(3), strict=True):
                at, value = np.array(at.as_py(), np.int64), np.array(times.as_py(), float)
                value = value * shared.value[at]
                kept = np.flatnonzero(value)
                rows.append((at[kept].astype("<i4").tobytes(), value[kept].astype("<f8").tobytes()))
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], *(pa.array([r[k] for r in rows], pa.binary()) for k in range(2))], ["grade", "turn", "at", "value"])

    used = told.mapInArrow(store.lean(telling), "grade int, turn long, at binary, value binary")
    so_far = Window.partitionBy("grade").orderBy("turn", "at", "value")  # at most `sample` ids a grade
    used = store.stage(used.withColumn("entries", F.sum(F.octet_length("at") / 4).over(so_far)).where(F.col("entries") <= ENTRIES), "used")
    rows = used.collect()  # at most GRADES * ENTRIES indexes and values
    ordered = sorted((r["grade"], bytes(r["at"]), bytes(r["value"])) for r in rows)
    weights, thresholds = fit([(g, np.frombuffer(at, "<i4"), np.frombuffer(value, "<f8")) for g, at, value in ordered])
    return weights * factor, thresholds


def score(docs: DataFrame, model, id_column: str = "doc_id", text_column: str = "text", reject: float = 0.25) -> DataFrame:
    """Adds severity (the expected grade), grade (the likeliest) and rejected (the chance of any toxic grade is over `reject`).

    Null texts and those without a letter get severity 0 and stay.  Every row
    is scored by itself, so repeated rows get equal values.  The added
    columns' names follow store.free.
    """
    added = store.free(docs, "severity", "grade", "rejected")
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def grades(batches):
        import numpy as np
        import pyarrow as pa

        weights, (low, high) = shared.value
        told = weights.tolist()

        class Memo(dict):
            """Words met of late, and of those met before them as many."""

            older = {}  # noqa: RUF012

            def __missing__(self, word):
                if (own := self.older.get(word)) is None:
                    own = sum(told[k] for k in word_features(word))
                if 2 * len(self) >= MEMO:
                    self.older = dict(self)
                    self.clear()
                self[word] = own
                return own

        memo = Memo()
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                batch = whole.slice(at, 256)
                texts = [text.as_py() or b"" for text in batch.column(batch.schema.get_field_index(text_column)).cast(pa.binary())]
                s = np.array([sum(map(memo.__getitem__, sorted(own))) if (own := words(text)) else -np.inf for text in texts])
                over = 1 / (1 + np.exp(np.clip(np.stack([low - s, high - s]), -40, 40)))
                over[:, np.isinf(s)] = 0
                severity, each = over.sum(axis=0), np.stack([1 - over[0], over[0] - over[1], over[1]])
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(severity.round(6)), pa.array(each.argmax(axis=0).astype(np.int32)), pa.array(over[0] > reject)], [*batch.schema.names, *added])

    return store.mapped(docs, grades, [*docs.dtypes, *zip(added, ("double", "int", "boolean"), strict=True)])
