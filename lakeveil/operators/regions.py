"""Tables of image regions (G1 to G10): detections decoded, thinned, scaled and decided on; no inference."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# The model's input size, thresholds and margins.
WIDTH, HEIGHT, SCORE, OVERLAP, MARGIN, PERSON, LEAST_CROP, MOST_CROPS = 320, 240, 0.7, 0.3, 0.25, 0.08, 24, 12


def decode(found: DataFrame) -> DataFrame:
    """G1: normalized corners of a letterboxed model input as boxes of the source image; below the score or two pixels they go."""
    scale = F.least(F.lit(WIDTH) / F.col("src_w"), F.lit(HEIGHT) / F.col("src_h"))
    left, top = (WIDTH - F.col("src_w") * scale) / 2, (HEIGHT - F.col("src_h") * scale) / 2
    clamp = lambda c, most: F.greatest(F.lit(0.0), F.least(c, most.cast("double")))
    corner = {x: clamp((F.col(x) * WIDTH - left) / scale, F.col("src_w")) for x in ("x1", "x2")} | {y: clamp((F.col(y) * HEIGHT - top) / scale, F.col("src_h")) for y in ("y1", "y2")}
    box = F.struct(corner["x1"].alias("x"), corner["y1"].alias("y"), (corner["x2"] - corner["x1"]).alias("w"), (corner["y2"] - corner["y1"]).alias("h"))
    return found.where(F.col("score") >= SCORE).withColumn("box", box).where("box.w >= 2 and box.h >= 2").drop("x1", "y1", "x2", "y2")


def overlap(a: Column, b: Column) -> Column:
    """Intersection over union of two boxes."""
    w = F.greatest(F.lit(0.0), F.least(a["x"] + a["w"], b["x"] + b["w"]) - F.greatest(a["x"], b["x"]))
    h = F.greatest(F.lit(0.0), F.least(a["y"] + a["h"], b["y"] + b["h"]) - F.greatest(a["y"], b["y"]))
    return F.coalesce(F.try_divide(w * h, a["w"] * a["h"] + b["w"] * b["h"] - w * h), F.lit(0.0))


def thin(found: DataFrame, image: str = "image_id", most: float = OVERLAP) -> DataFrame:
    """Of boxes that overlap by more than ``most`` the one of the highest score stays, greedily by image."""
    kind = "array<struct<score:double,box:struct<x:double,y:double,w:double,h:double>>>"
    rows = found.groupBy(image).agg(F.sort_array(F.collect_list(F.struct(F.col("score").cast("double").alias("score"), F.col("box").alias("box"))), asc=False).cast(kind).alias("all"))
    kept = F.aggregate("all", F.array().cast(kind), lambda acc, x: F.when(F.exists(acc, lambda a: overlap(a["box"], x["box"]) > most), acc).otherwise(F.concat(acc, F.array(x))))
    return rows.select(image, F.explode(kept).alias("k")).select(image, "k.score", "k.box")


def expand(box: Column, margin: float = MARGIN) -> Column:
    """A quarter more on each side; the origin stays within the image."""
    return F.struct(F.greatest(F.lit(0.0), box["x"] - box["w"] * margin).alias("x"), F.greatest(F.lit(0.0), box["y"] - box["h"] * margin).alias("y"), (box["w"] * (1 + 2 * margin)).alias("w"), (box["h"] * (1 + 2 * margin)).alias("h"))


def scale(box: Column, view: Column, image: Column) -> Column:
    """Page pixels as image pixels; as they are without a viewport."""
    sx, sy = (F.coalesce(F.try_divide(image[s], view[s]), F.lit(1.0)) for s in "wh")
    return F.struct((box["x"] * sx).alias("x"), (box["y"] * sy).alias("y"), (box["w"] * sx).alias("w"), (box["h"] * sy).alias("h"))


def mask(box: Column, image: Column) -> Column:
    """The whole pixels to cover, two beyond the box, within the image; null where nothing is left."""
    x, y = F.greatest(F.lit(0), F.floor(box["x"]) - 2), F.greatest(F.lit(0), F.floor(box["y"]) - 2)
    w, h = F.least(F.ceil(box["w"]) + 4, image["w"] - x), F.least(F.ceil(box["h"]) + 4, image["h"] - y)
    return F.when((w > 0) & (h > 0), F.struct(x.alias("x"), y.alias("y"), w.alias("w"), h.alias("h")))


def complete(requested: DataFrame, applied: DataFrame, image: str = "image_id") -> DataFrame:
    """Images whose masks were all applied may be sent, others are withheld."""
    counts = requested.groupBy(image).agg(F.count(F.lit(1)).alias("requested")).join(applied.groupBy(image).agg(F.count(F.lit(1)).alias("applied")), image, "left").fillna(0, ["applied"])
    return counts.withColumn("send", F.col("applied") >= F.col("requested"))


def softmax_top(logits: Column, k: int = 3) -> Column:
    """The ``k`` likeliest labels as array<struct<p, label>>, the likeliest first, lower labels first on ties."""
    top = F.array_max(logits)
    odds = F.transform(logits, lambda x: F.exp(x - top))
    total = F.aggregate(odds, F.lit(0.0), lambda s, x: s + x)
    ranked = F.array_sort(F.transform(odds, lambda x, i: F.struct((-(x / total)).alias("m"), i.alias("label"))))
    return F.transform(F.slice(ranked, 1, k), lambda r: F.struct((-r["m"]).alias("p"), r["label"].alias("label")))


def likely_person(top: Column, labels: list[int]) -> Column:
    return F.exists(top, lambda t: t["label"].isin(labels) & (t["p"] > PERSON))


def eligible(crops: DataFrame, page: str = "page_id", order: str = "node_seq", most: int = MOST_CROPS) -> DataFrame:
    """Crops of 24 by 24 pixels or more, the first twelve of a page, as the operator's limit says."""
    nth = F.row_number().over(Window.partitionBy(page).orderBy(order))
    return crops.where((F.col("box.w") >= LEAST_CROP) & (F.col("box.h") >= LEAST_CROP)).withColumn("__nth", nth).where(F.col("__nth") <= most).drop("__nth")


def image_decision(pages: DataFrame) -> DataFrame:
    """Withhold, skip or masked, from the flags unreadable, beyond_cap and queue (how many regions need an image)."""
    withheld = F.coalesce(F.col("unreadable"), F.lit(False)) | F.coalesce(F.col("beyond_cap"), F.lit(False))
    return pages.withColumn("decision", F.when(withheld, "withhold").when(F.coalesce("queue", F.lit(0)) == 0, "skip").otherwise("masked"))


def annotate(nodes: DataFrame, results: DataFrame) -> DataFrame:
    """Classifier results (image_label, confidence, likely_person) beside the nodes that they belong to."""
    return nodes.join(results.select("page_id", "node_seq", "image_label", "confidence", "likely_person"), ["page_id", "node_seq"], "left")
