"""ROC AUC and rolling means, spread over tasks by balanced ranges."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidegauge.operators.ordering import RowOrder, Splits
from tidegauge.operators.running import with_running
from tidegauge.settings import ROLLING_ROWS

def roc_auc(df: DataFrame, score: str, label: str, by: Sequence[str] = ()) -> DataFrame:
    """Exact area under the ROC curve per group: by..., auc, n, label_rate.

    Equal scores are counted together first, ties at half; running counts then go by
    ranges of scores. NULL where one class is absent.
    """
    by = list(by)
    values = df.select(*by, F.col(score).cast("double").alias("_score"), F.col(label).cast("bigint").alias("_label"))
    counted = values.groupBy(*by, "_score").agg(
        F.sum("_label").alias("_pos"), F.sum(1 - F.col("_label")).alias("_neg")
    )
    stepped = with_running(counted, by, ["_score"], {"_below": "_neg"})
    won = F.sum(F.col("_pos").cast("double") * (F.col("_below") + F.col("_neg") / 2))
    pos, neg = F.sum("_pos"), F.sum("_neg")
    return stepped.groupBy(*by).agg(
        F.try_divide(won, pos.cast("double") * neg).alias("auc"),
        (pos + neg).alias("n"),
        F.try_divide(pos, pos + neg).alias("label_rate"),
    )


def rolling_mean(
    df: DataFrame, order: RowOrder, value: str, rows: int = ROLLING_ROWS, into: str = "rolling_mean"
) -> DataFrame:
    """Mean of ``value`` over the row and up to ``rows - 1`` rows before it in ``order``.

    The rows are cut into equal parts, one per shuffle partition, each long
    enough to fill a frame. The last rows of a part also travel to the next one,
    where they complete the first frames and are then dropped.
    """
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    carry = rows - 1

    def positions(total: Column) -> Column:
        count = F.greatest(F.lit(1), F.least(F.lit(parts), F.floor(total / F.lit(rows)))).cast("bigint")
        cuts = F.transform(F.sequence(F.lit(1).cast("bigint"), count), lambda i: F.floor(i * total / count))
        inner = F.slice(cuts, 1, (count - 1).cast("int"))
        return F.flatten(F.transform(inner, lambda cut: F.array(cut - carry, cut)))

    placed = Splits.find(df, order, positions).with_part(df, "_zone")
    # Zone 2i is the middle of part i, zone 2i + 1 its last rows, which part i + 1 needs too.
    part = F.shiftright("_zone", 1)
    own = F.struct(part.alias("part"), F.lit(False).alias("carried"))
    passed_on = F.struct((part + 1).alias("part"), F.lit(True).alias("carried"))
    copies = F.when(F.col("_zone") % 2 == 1, F.array(own, passed_on)).otherwise(F.array(own))
    spread = placed.withColumn("_copy", F.explode(copies))
    frame = Window.partitionBy("_copy.part").orderBy(*order.levels).rowsBetween(-carry, 0)
    return (
        spread.withColumn(into, F.avg(value).over(frame))
        .where(~F.col("_copy.carried"))
        .select(*df.columns, into)
    )
