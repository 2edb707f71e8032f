"""Training sets: splits, class indices, YOLO, COCO and OCR rows, manifest."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sheetweave.functions import geometry as G
from sheetweave.functions.text import md5_mod_1000, split_of
from sheetweave.operators.running import SUM, running
from sheetweave.scratch import kept


#: What tells tiles apart.
TILE = ["image_id", "tile_id"]


def assign_splits(images: DataFrame) -> DataFrame:
    """(image_id, split) by hash; of three or more images, valid and then test get the last train image if they have none
    and train keeps one. Counts and the two last ids are one row, so nothing is sorted globally."""
    rows = images.select("image_id").distinct().withColumn("split", split_of(F.col("image_id")))
    train = F.col("split") == "train"
    last = rows.where(train).orderBy(F.desc("image_id")).limit(2).agg(F.array_sort(F.collect_list("image_id")).alias("last"))
    n = rows.agg(
        F.count("*").alias("n"), F.count_if(train).alias("train"), F.count_if(F.col("split") == "valid").alias("valid"),
        F.count_if(F.col("split") == "test").alias("test")
    ).crossJoin(last)
    needs_v, needs_t = (F.col("n") >= 3) & (F.col("valid") == 0) & (F.col("train") > 1), (F.col("n") >= 3) & (F.col("test") == 0)
    takes_t = needs_t & (F.col("train") - needs_v.cast("int") > 1)
    plan = n.select(
        F.when(needs_v, F.element_at("last", -1)).alias("to_valid"),
        F.when(takes_t & needs_v, F.try_element_at("last", F.lit(-2))).when(takes_t, F.element_at("last", -1)).alias("to_test")
    )
    out = rows.crossJoin(F.broadcast(plan))  # one row
    return out.select(
        "image_id",
        F.when(F.col("image_id") == F.col("to_valid"), "valid").when(F.col("image_id") == F.col("to_test"), "test").otherwise(F.col("split")).alias("split")
    )


def class_index(labels: DataFrame, first: int = 0) -> DataFrame:
    """(label, idx): class names in order from `first` (0 for YOLO, 1 for COCO). One row per class."""
    return labels.select("label").distinct().withColumn("idx", F.row_number().over(Window.orderBy("label")) - 1 + first)


def yolo_rows(objects: DataFrame, index: DataFrame) -> DataFrame:
    """Tile objects g0..g3 (with tw, th) as class index and centre box relative to the tile."""
    g = G.quad("g")
    out = objects.join(F.broadcast(index), "label")  # a row for each class; by label a class would be one task
    return out.withColumns({"cx": (g[0] + g[2] / 2) / F.col("tw"), "cy": (g[1] + g[3] / 2) / F.col("th"), "rw": g[2] / F.col("tw"), "rh": g[3] / F.col("th")})


def yolo_files(rows: DataFrame, tiles: DataFrame) -> DataFrame:
    """(split, name, lines): the label file of each tile of tiles (split, name, image_id, tile_id), its rows of yolo_rows() in
    item order; a tile without objects has an empty file."""
    line = F.format_string("%d %.6f %.6f %.6f %.6f", "idx", "cx", "cy", "rw", "rh")
    texts = rows.groupBy(*TILE).agg(F.array_sort(F.collect_list(F.struct("item_idx", line.alias("line")))).alias("l"))
    found = F.array_join(F.transform("l", lambda x: x["line"]), "\n")
    return tiles.select("split", "name", *TILE).join(texts, TILE, "left").select("split", "name", F.coalesce(found, F.lit("")).alias("lines"))


def coco_rows(arrows: DataFrame, index: DataFrame) -> DataFrame:
    """Tile segments as padded boxes: first x and y are raised to 0 (width and height stay), then w and h are cut at the tile."""
    x, y, w, h = G.segment_to_box(G.quad("g"))
    out = arrows.join(F.broadcast(index), "label")  # a row for each class; by label a class would be one task
    out = out.withColumns({"x": F.greatest(F.lit(0.0), x), "y": F.greatest(F.lit(0.0), y), "w0": w, "h0": h})
    out = out.withColumns({"w": F.least("w0", F.col("tw") - F.col("x")), "h": F.least("h0", F.col("th") - F.col("y"))}).drop("w0", "h0")
    return out.withColumn("area", F.col("w") * F.col("h"))


def number_within(rows: DataFrame, part: str, order: list[str], name: str) -> DataFrame:
    """Running ids from 0 within a split. Neither a split's rows nor a row for each of its images meet in one task."""
    ran = running(rows, [part], [F.col(c).asc() for c in order], {name: (SUM, F.lit(1).cast("long"))})
    return ran.withColumn(name, F.col(name) - 1)


def ocr_crops(texts: DataFrame, pad: int = 3) -> DataFrame:
    """The pixel window x0, y0, x1, y1 of each text crop: whole pixels, padded, within the tile's lower edge; empty ones go."""
    g = [F.bround(c, 0).cast("long") for c in G.quad("g")]
    out = texts.withColumns({
        "x0": F.greatest(F.lit(0), g[0] - pad), "y0": F.greatest(F.lit(0), g[1] - pad), "x1": F.least(g[0] + g[2] + pad, F.col("tw").cast("long")),
        "y1": F.least(g[1] + g[3] + pad, F.col("th").cast("long"))
    })
    return out.where("x1 > x0 AND y1 > y0")


def manifest(detections: DataFrame) -> DataFrame:
    """One row: sorted class lists, items of each class of objects and arrows, and of each kind and in all."""
    per = detections.groupBy("kind", "label").agg(F.count("*").alias("n"))
    of = lambda k: F.col("kind") == k
    names = lambda k: F.array_sort(F.collect_set(F.when(of(k), F.col("label"))))
    counts = lambda k: F.map_from_entries(F.array_sort(F.collect_list(F.when(of(k), F.struct("label", "n")))))
    kinds = [F.coalesce(F.sum(F.when(of(k), F.col("n"))), F.lit(0)).alias(n) for k, n in (("object", "objects"), ("ocr", "texts"), ("arrow", "arrows"))]
    return per.agg(
        names("object").alias("object_classes"), names("arrow").alias("arrow_classes"),
        counts("object").alias("object_class_counts"), counts("arrow").alias("arrow_class_counts"), *kinds, F.coalesce(F.sum("n"), F.lit(0)).alias("items"),
    )


def with_missing_tiles(annotated: DataFrame, grid: DataFrame, images: DataFrame) -> DataFrame:
    """Every tile of every image, with its annotations where it has any. The grid is a few rows."""
    every = images.select("image_id").crossJoin(F.broadcast(grid.select("tile_id")))
    return every.join(annotated, ["image_id", "tile_id"], "left")


def sample_empty(tiles: DataFrame, ratio: float = 0.2) -> DataFrame:
    """All tiles with items (n_items > 0) and about `ratio` of the others, chosen by a hash of image and tile."""
    draw = md5_mod_1000(F.concat_ws("/", "image_id", "tile_id"))
    return tiles.where((F.coalesce(F.col("n_items"), F.lit(0)) > 0) | (draw < int(ratio * 1000)))


class TrainingSet:
    """The tables of a training set, each made when it is asked for; all but the manifest and the categories carry split.

    What several of them read is written once. Everything goes by image and tile: an item meets its tile in one shuffle, and
    COCO ids are counted over images (a row for each in the range partitions of running()), then within an image and a tile."""

    def __init__(self, images: DataFrame, detections: DataFrame, grid: DataFrame, ratio: float):
        self._given, self._grid, self._ratio = images, grid, ratio
        self._detections = detections.select(*TILE, "kind", "item_idx", *[f"g{i}" for i in range(4)], "label")

    @cached_property
    def _images(self) -> DataFrame:
        return kept(self._given.select("image_id").distinct())

    @cached_property
    def _items(self) -> DataFrame:
        return kept(self._detections)

    @cached_property
    def _sizes(self) -> DataFrame:
        """As many rows as the grid has tiles, for broadcasts."""
        return self._grid.select("tile_id", F.col("tw").cast("double").alias("tw"), F.col("th").cast("double").alias("th"))

    @cached_property
    def _labels(self) -> DataFrame:
        """(kind, label) of the items that have a tile; a tile with items always stays. Labels alone need no table of items."""
        some = self.__dict__.get("_items", self._detections).where("kind <> 'ocr'").join(F.broadcast(self._sizes.select("tile_id")), "tile_id", "left_semi")
        per = some.select("image_id", "kind", "label").distinct()  # a few rows for each image
        return kept(per.join(self._images.hint("merge"), "image_id").select("kind", "label").distinct())  # images, as many as there are, are not sent whole

    def _classes(self, kind: str, first: int) -> DataFrame:
        return class_index(self._labels.where(F.col("kind") == kind), first)

    @cached_property
    def _chosen(self) -> DataFrame:
        """The tiles with the number of their COCO annotations."""
        arrow = (F.col("kind") == "arrow") & F.col("label").isNotNull()  # what has no class gets no annotation
        found = kept(self._items.groupBy(*TILE).agg(F.count("*").alias("n_items"), F.count_if(arrow).alias("n_arrows")))
        known = self._images.join(found.select("image_id").distinct(), "image_id", "left_semi")
        chosen = sample_empty(with_missing_tiles(found, self._grid, known), self._ratio).join(assign_splits(self._images), "image_id")
        return kept(chosen.select("split", *TILE, F.concat_ws("_", *TILE).alias("name"), F.coalesce("n_arrows", F.lit(0)).alias("n_arrows")))

    @cached_property
    def _numbered(self) -> DataFrame:
        """The tiles with their COCO id and that of their first annotation."""
        ones = {"_tiles": (SUM, F.col("_n")), "_arrows": (SUM, F.col("_a"))}
        per = self._chosen.groupBy("split", "image_id").agg(F.count("*").alias("_n"), F.sum("n_arrows").alias("_a"))
        before = running(per, ["split"], [F.col("image_id").asc()], ones, before=True).select("image_id", "_tiles", "_arrows")
        along = Window.partitionBy("image_id").orderBy("tile_id")  # an image's tiles
        earlier = F.coalesce(F.sum("n_arrows").over(along.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        tiles = self._chosen.withColumns({"_place": F.row_number().over(along) - 1, "_earlier": earlier}).join(before, "image_id")
        zero = lambda c: F.coalesce(F.col(c), F.lit(0))
        return kept(tiles.select("split", *TILE, "name", (zero("_tiles") + F.col("_place")).alias("id"), (zero("_arrows") + F.col("_earlier")).alias("first")))

    def _rows(self, kind: str | None = None, tiles: DataFrame | None = None) -> DataFrame:
        """Items of a kind, or all, with split and name of their tile (and what else tiles has) and its size."""
        some = self._items if kind is None else self._items.where(F.col("kind") == kind)
        return some.join(self.tiles if tiles is None else tiles, TILE).join(F.broadcast(self._sizes), "tile_id")

    @cached_property
    def tiles(self) -> DataFrame:
        """split, image_id, tile_id, name"""
        return self._chosen.select("split", *TILE, "name")

    @cached_property
    def annotations(self) -> DataFrame:
        """split, name, kind, item_idx, g0..g3, label"""
        return self._rows().select("split", "name", "kind", "item_idx", *[f"g{i}" for i in range(4)], "label")

    @cached_property
    def yolo(self) -> DataFrame:
        """split, name, lines"""
        objects = self._items.where(F.col("kind") == "object").join(F.broadcast(self._sizes), "tile_id")
        return yolo_files(yolo_rows(objects, self._classes("object", 0)), self.tiles)

    @cached_property
    def coco_images(self) -> DataFrame:
        """split, id, file_name, width, height"""
        return self._numbered.join(F.broadcast(self._sizes), "tile_id").select(
            "split", "id", F.concat("name", F.lit(".png")).alias("file_name"), F.col("tw").cast("int").alias("width"), F.col("th").cast("int").alias("height")
        )

    @cached_property
    def coco_annotations(self) -> DataFrame:
        """split, id, image_id, category_id, bbox, area"""
        rows = coco_rows(self._rows("arrow", self._numbered.withColumnRenamed("id", "image")), self._classes("arrow", 1))
        place = F.row_number().over(Window.partitionBy(*TILE).orderBy("item_idx")) - 1  # a tile's segments
        return rows.select(
            "split", (F.col("first") + place).alias("id"), F.col("image").alias("image_id"), F.col("idx").alias("category_id"), F.array(*"xywh").alias("bbox"), "area"
        )

    @cached_property
    def coco_categories(self) -> DataFrame:
        """id, name, supercategory"""
        placeholder = self._grid.sparkSession.createDataFrame([(0, "annotation-lines", "none")], "id long, name string, supercategory string")
        return placeholder.unionByName(self._classes("arrow", 1).select(
            F.col("idx").cast("long").alias("id"), F.col("label").alias("name"), F.lit("annotation-lines").alias("supercategory")
        ))

    @cached_property
    def ocr(self) -> DataFrame:
        """split, crop, text, tile, x0..y1"""
        crop = F.concat(F.lit("ocr/crops/"), "name", F.lit("_"), F.col("item_idx").cast("string"), F.lit(".png"))
        return ocr_crops(self._rows("ocr")).select("split", crop.alias("crop"), F.col("label").alias("text"), F.col("name").alias("tile"), "x0", "y0", "x1", "y1")

    @cached_property
    def manifest(self) -> DataFrame:
        sizes = self.tiles.agg(*[F.count_if(F.col("split") == k).alias(f"{k}_tiles") for k in ("train", "valid", "test")])
        return manifest(self._rows()).crossJoin(sizes)  # one row each


def build(images: DataFrame, detections: DataFrame, grid: DataFrame, ratio: float = 0.2) -> TrainingSet:
    """A training set from images (image_id) and their ground truth cut into tiles (image_id, tile_id, kind, item_idx,
    g0..g3, label). Splits are dealt over all images, images without any annotation are then left out; of tiles without
    items about `ratio` stay. COCO ids count from 0 within a split, category 0 is the placeholder that its readers expect."""
    return TrainingSet(images, detections, grid, ratio)


def write(built: TrainingSet, out: str) -> None:
    """All tables below out, as JSON lines in one folder for each split (split=train and so on), so that a split is read
    alone by its folder. Class lists and the description for YOLO trainers are small files of their own."""
    for name in ("tiles", "annotations", "yolo", "coco_images", "coco_annotations", "ocr"):
        getattr(built, name).write.mode("overwrite").partitionBy("split").json(f"{out}/{name}")
    built.coco_categories.coalesce(1).write.mode("overwrite").json(f"{out}/coco_categories")
    built.manifest.coalesce(1).write.mode("overwrite").json(f"{out}/manifest")
    classes = built.manifest.select("object_classes")
    classes.select(F.to_json("object_classes").alias("value")).coalesce(1).write.mode("overwrite").text(f"{out}/yolo_classes")
    lines = F.array_join(F.transform("object_classes", lambda c, i: F.concat(F.lit("  "), i.cast("string"), F.lit(": "), c)), "\n")
    head = "train: images/train\nval: images/valid\ntest: images/test\nnames:\n"
    classes.select(F.concat(F.lit(head), lines).alias("value")).coalesce(1).write.mode("overwrite").text(f"{out}/yolo_data")


def read_annotations(spark: SparkSession, out: str, split: str | None = None) -> DataFrame:
    """The annotations of one split, or of all, of a training set on disk, by tile and item."""
    rows = spark.read.json(f"{out}/annotations")
    return (rows if split is None else rows.where(F.col("split") == split)).orderBy("split", "name", "kind", "item_idx")
