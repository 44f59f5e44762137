"""Queries of components: masks with gaps and corners over the synthetic images."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import images, labels
from .registry import register
from .study import PIXELS_SQL, synthetic_pixels

#: The mask: the mark, cut into columns that a few rows join again, and by a diagonal that corners cross.
MASK = "v = 120 AND ((x + id) % 9 <> 4 OR y % 16 = 7 AND x % 18 <> 13) AND (x + y) % 23 <> 11"

LABELS_SQL = f"""WITH RECURSIVE {PIXELS_SQL}, mask AS (SELECT id, x::BIGINT AS x, y::BIGINT AS y FROM pixels WHERE {MASK}),
    islands AS (SELECT *, x - row_number() OVER (PARTITION BY id, y ORDER BY x) AS island FROM mask),
    runs AS (SELECT id, y, min(x) AS x0, max(x) AS x1, y * 2147483648 + min(x) AS run FROM islands GROUP BY id, y, island),
    half AS (SELECT a.id, a.run AS a, b.run AS b FROM runs a JOIN runs b ON a.id = b.id AND b.y = a.y + 1 AND a.x0 <= b.x1 + 1 AND b.x0 <= a.x1 + 1),
    edges AS (SELECT id, a, b FROM half UNION ALL SELECT id, b, a FROM half),
    reached(id, run, least) USING KEY (id, run) AS (
        SELECT id, run, run FROM runs
        UNION SELECT e.id, e.b, min(r.least) FROM reached r JOIN edges e ON e.id = r.id AND e.a = r.run JOIN recurring.reached o ON o.id = e.id AND o.run = e.b WHERE r.least < o.least GROUP BY e.id, e.b),
    spans AS (SELECT id, y, x0, x1, dense_rank() OVER (PARTITION BY id ORDER BY least)::INTEGER AS label FROM runs JOIN reached USING (id, run)),
    st AS (SELECT id, label, sum(x1 - x0 + 1)::BIGINT AS area, min(x0) AS x, min(y) AS y, max(x1) - min(x0) + 1 AS w, max(y) - min(y) + 1 AS h,
        sum((x0 + x1) * (x1 - x0 + 1))::DOUBLE / 2 / sum(x1 - x0 + 1) AS cx, sum(y * (x1 - x0 + 1))::DOUBLE / sum(x1 - x0 + 1) AS cy FROM spans GROUP BY ALL)"""


def spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return labels.labelled_runs(synthetic_pixels(spark, sf_dir).filter(MASK))


@register(f"{LABELS_SQL} SELECT * FROM spans")
def labelled_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spans(spark, sf_dir)


@register(f"{LABELS_SQL} SELECT * FROM st")
def component_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return labels.run_stats(spans(spark, sf_dir))


@register(f"{LABELS_SQL}, k AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY area DESC, label) AS rank FROM st WHERE area > 64 * 64 * 0.01) SELECT id, arg_min(label, cx * 10 + rank) AS label FROM k WHERE rank <= 2 GROUP BY 1")
def pick_component(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of the two largest components over one hundredth of the image, the one further left."""
    return images.pick_component(labels.run_stats(spans(spark, sf_dir)), F.lit(64 * 64), 0.01)
