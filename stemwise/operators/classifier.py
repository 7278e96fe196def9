"""Text-only option classifier: TF-IDF and surface features into logistic regression."""

from __future__ import annotations

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import CountVectorizer, NGram, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.window import Window

from ..functions import text as T
from .surface import DENSE

GRID = (0.1, 1.0, 10.0)


def word_grams(df: DataFrame) -> DataFrame:
    """Adds ``grams``: the words of two or more characters, and their pairs."""
    words = T.found(F.lower("text"), r"(?U)\b\w\w+\b")
    out = NGram(n=2, inputCol="words", outputCol="pairs").transform(df.withColumn("words", words))
    return out.withColumn("grams", F.concat("words", "pairs")).drop("words", "pairs")


def idf(df: DataFrame, min_df: int = 5) -> DataFrame:
    """(gram, df, idf): smoothed inverse document frequency of the training grams."""
    n = df.agg(F.count("*").alias("n"))
    seen = df.select(F.explode(F.array_distinct("grams")).alias("gram")).groupBy("gram").agg(F.count("*").alias("df")).filter(F.col("df") >= min_df)
    return seen.crossJoin(F.broadcast(n)).select("gram", "df", (F.log((1 + F.col("n")) / (1 + F.col("df"))) + 1).alias("idf"))


def scale(train: DataFrame, df: DataFrame) -> DataFrame:
    """Standardises the dense features by the training rows' mean and population deviation."""
    moments = train.agg(*(F.avg(c).alias(f"m_{c}") for c in DENSE), *(F.coalesce(F.nullif(F.stddev_pop(c), F.lit(0.0)), F.lit(1.0)).alias(f"s_{c}") for c in DENSE))
    return df.crossJoin(F.broadcast(moments)).select(*df.columns[: len(df.columns)], *(((F.col(c) - F.col(f"m_{c}")) / F.col(f"s_{c}")).alias(f"z_{c}") for c in DENSE))


def best_of(scores: list[tuple[float, float]]) -> float:
    """Of (C, accuracy) in the grid's order the C of the highest accuracy; of equals the first."""
    best = None
    for c, accuracy in scores:
        if best is None or accuracy > best[1]:
            best = c, accuracy
    return best[0]


def labelled_rows(options: DataFrame) -> DataFrame:
    """(item_pos, letter, label): a row and a binary label for each option."""
    return options.select("item_pos", "letter", F.col("is_gold").cast("int").alias("label"))


class OptionClassifier:
    """fit on option rows (item_pos, letter, letter_idx, text, is_gold, DENSE, part)."""

    def __init__(self, min_df: int = 5, vocabulary: int = 200_000, use_text: bool = True, grid: tuple[float, ...] = GRID, path: str | None = None):
        """``path``: a folder where features are written once, not made anew for each C."""
        self.min_df, self.vocabulary, self.use_text, self.grid, self.path = min_df, vocabulary, use_text, grid, path

    def _kept(self, df: DataFrame, name: str) -> DataFrame:
        if self.path is None:
            return df
        df.write.mode("overwrite").parquet(f"{self.path}/{name}")
        return df.sparkSession.read.parquet(f"{self.path}/{name}")

    def _features(self, df: DataFrame) -> DataFrame:
        out = scale(self.train, word_grams(df)).withColumn("one", F.lit(1.0))
        columns = [*(f"z_{c}" for c in DENSE), "one"]
        if self.use_text:
            out = self.counts.transform(out).withColumn("tfidf", self.weigh(F.col("tf")))
            columns.append("tfidf")
        return VectorAssembler(inputCols=columns, outputCol="features").transform(out)

    def fit(self, rows: DataFrame) -> "OptionClassifier":
        self.train = rows.filter("part = 'fit'")
        if self.use_text:
            grams = self._kept(word_grams(self.train).select("grams"), "grams")
            self.counts = CountVectorizer(inputCol="grams", outputCol="tf", minDF=float(self.min_df), vocabSize=self.vocabulary).fit(grams)
            order = {g: i for i, g in enumerate(self.counts.vocabulary)}
            weights = [1.0] * len(order)
            known = self.train.sparkSession.createDataFrame([(g,) for g in order], "gram string")
            for gram, _, w in idf(grams, self.min_df).join(F.broadcast(known), "gram", "left_semi").toLocalIterator():
                weights[order[gram]] = w
            from pyspark.ml.linalg import SparseVector, VectorUDT

            held = self.train.sparkSession.sparkContext.broadcast(weights)

            @F.udf(VectorUDT())
            def weigh(v):
                """Sublinear tf times idf, rows of length one."""
                from math import log, sqrt

                values = [(1 + log(x)) * held.value[i] for i, x in zip(v.indices.tolist(), v.values.tolist())]
                norm = sqrt(sum(x * x for x in values)) or 1.0
                return SparseVector(v.size, v.indices, [x / norm for x in values])

            self.weigh = weigh
        fit = self._kept(self._features(self.train).select("features", F.col("is_gold").cast("double").alias("label")), "fit")
        validation = self._kept(self._features(rows.filter("part = 'validation'")).select("item_pos", "bank", "letter", "letter_idx", "is_gold", "features"), "validation")
        n, models, scores = fit.count(), {}, []
        for c in self.grid:
            # The constant is a feature, so it is penalised like the others.
            model = LogisticRegression(regParam=1 / (c * n), elasticNetParam=0.0, standardization=False, fitIntercept=False, maxIter=1000, tol=1e-4).fit(fit)
            self.model = model
            got = self._picked(validation).agg(F.avg((F.col("pick") == F.col("gold")).cast("int"))).first()[0] or 0.0
            models[c] = model
            scores.append((c, got))
        self.c = best_of(scores)
        self.accuracy, self.model = dict(scores)[self.c], models[self.c]
        return self

    def picks(self, rows: DataFrame) -> DataFrame:
        """(item_pos, bank, pick, gold): the option of the highest score; of equals the first."""
        return self._picked(self._features(rows))

    def _picked(self, features: DataFrame) -> DataFrame:
        scored = self.model.transform(features).withColumn("score", vector_to_array("rawPrediction")[1])
        return scored.groupBy("item_pos", "bank").agg(F.max_by("letter", F.struct(F.col("score"), -F.col("letter_idx"))).alias("pick"), F.max(F.when(F.col("is_gold"), F.col("letter"))).alias("gold"))


def document_weights(df: DataFrame) -> DataFrame:
    """Sublinear TF-IDF of (item_pos, letter, grams) by SQL: (item_pos, letter, gram, w)."""
    tf = df.select("item_pos", "letter", F.explode("grams").alias("gram")).groupBy("item_pos", "letter", "gram").agg(F.count("*").alias("tf"))
    w = tf.join(idf(df), "gram").withColumn("w", (1 + F.log("tf")) * F.col("idf"))
    return w.withColumn("w", F.col("w") / F.sqrt(F.sum(F.col("w") * F.col("w")).over(Window.partitionBy("item_pos", "letter")))).select("item_pos", "letter", "gram", "w")
