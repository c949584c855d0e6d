"""Regions: classes, reading order, gutters, clusters, coverage."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quirewise.functions import geometry as G
from quirewise.sources.storage import dealt, stored

#: Where a class of region goes in the document, and its rank in reading order.
CLASSES = (
    ("header", "→ running head", 0), ("page_number", "→ page number", 1), ("heading", "→ body", 2), ("body", "→ body", 2), ("table", "→ body", 2), ("illustration", "→ image", 2), ("marginalia", "→ side note", 3),
    ("footnote", "→ footnote", 4), ("footer", "→ footer", 5), ("catchword", "archive only", 6), ("uncertain", "review", 7), ("ignore", "excluded", 8),
)
#: Classes whose words are not text.
NOT_TEXT = ("ignore", "illustration")


def class_rank(kind: Column) -> Column:
    out = F.lit(7)
    for k, _, rank in CLASSES:
        out = F.when(kind == k, F.lit(rank)).otherwise(out)
    return out.cast("long")


def with_placement(regions: DataFrame) -> DataFrame:
    place = F.lit("review")
    for k, label, _ in CLASSES:
        place = F.when(F.col("kind") == k, F.lit(label)).otherwise(place)
    return regions.withColumn("placement", place).withColumn("class_rank", class_rank(F.col("kind"))).withColumn("structure", structure_of(F.col("kind")))


def structure_of(kind: Column) -> Column:
    return F.when(kind == "heading", "heading1").otherwise("text")


def box(of: str) -> Column:
    return F.struct(*(F.col(f"{of}.{c}") for c in "xywh"))


def first_region(words: DataFrame, regions: DataFrame) -> DataFrame:
    """Each word with the first region in order whose closed box has its centre; words of non-text regions go.

    Pages are the equality key, so the range test stays inside a page. Words of no region stay, without one.
    """
    w, r = words.alias("w"), regions.select("page_index", "region_id", "kind", "region_order", *"xywh").alias("r")
    hit = w.join(r, (F.col("w.page_index") == F.col("r.page_index")) & G.contains_center(box("r"), box("w")), "left")
    first = hit.groupBy("w.page_index", "w.seq").agg(F.min_by(F.struct("r.region_id", "r.kind"), "r.region_order").alias("_r"))
    first = first.select("page_index", "seq", F.col("_r.region_id").alias("region_id"), F.col("_r.kind").alias("kind"))
    return first.where(F.col("kind").isNull() | ~F.col("kind").isin(*NOT_TEXT))


#: Sides of the cells that small boxes are dealt into, in points.
CELL_W, CELL_H = 288.0, 56.0


def celled(boxes: DataFrame) -> DataFrame:
    """``boxes`` once for each grid cell they touch (_cx, _cy), with their first cell (_x0, _y0)."""
    cell = lambda at, size: F.floor(at / size).cast("int")
    firsts = boxes.withColumn("_x0", cell(F.col("x"), CELL_W)).withColumn("_y0", cell(F.col("y"), CELL_H))
    across = firsts.withColumn("_cx", F.explode(F.sequence("_x0", F.greatest(F.col("_x0"), cell(F.col("x") + F.col("w"), CELL_W)))))
    return across.withColumn("_cy", F.explode(F.sequence("_y0", F.greatest(F.col("_y0"), cell(F.col("y") + F.col("h"), CELL_H)))))


def touching(a: str, b: str) -> Column:
    """Join condition of celled ``a`` and ``b``: boxes of one page that intersect, each pair in the first cell they share."""
    same = lambda c: F.col(f"{a}.{c}") == F.col(f"{b}.{c}")
    first = lambda c, lo: F.col(f"{a}.{c}") == F.greatest(f"{a}.{lo}", f"{b}.{lo}")
    return same("page_index") & same("_cx") & same("_cy") & first("_cx", "_x0") & first("_cy", "_y0") & G.intersects(box(a), box(b))


def best_overlap(words: DataFrame, spans: DataFrame, least: float = 0.4) -> DataFrame:
    """The span with the most mutual overlap for each word; the earlier span of equals. Boxes meet in the cells of a page, not in all of it."""
    w, s = celled(words).alias("w"), celled(spans).alias("s")
    pairs = w.join(s, touching("w", "s"))
    share = F.greatest(G.overlap_fraction(box("w"), box("s")), G.overlap_fraction(box("s"), box("w")))
    best = F.max_by(F.struct(F.col("s.span_id"), share.alias("overlap")), F.struct(share, -F.col("s.seq"))).alias("_b")
    return pairs.groupBy(F.col("w.page_index").alias("page_index"), F.col("w.seq").alias("seq")).agg(best).select("page_index", "seq", "_b.span_id", "_b.overlap").where(F.col("overlap") >= least)


def reading_order(regions: DataFrame) -> DataFrame:
    order = Window.partitionBy("page_index").orderBy(class_rank(F.col("kind")), F.coalesce("column", F.lit(0)), "y", "x", "region_id")
    return regions.withColumn("reading_order", (F.row_number().over(order) - 1).cast("long"))


def gutters(boxes: DataFrame, min_w: float | str, max_cover: float = 0.08, least: int = 8) -> DataFrame:
    """White columns inside each page's band: runs of integer columns with little ink, wide enough, off the edges. ``min_w``: a number, or a column of
    ``boxes`` that is the same all over a page.

    Ink changes only where a box begins or ends, so it is a running sum over two rows a box.
    """
    page = Window.partitionBy("page_index")
    wide = F.max(F.col(min_w) if isinstance(min_w, str) else F.lit(float(min_w)))
    band = boxes.groupBy("page_index").agg(F.min("x").alias("bx"), F.min("y").alias("by"), F.max(F.col("x") + F.col("w")).alias("br"), F.max(F.col("y") + F.col("h")).alias("bb"), wide.alias("least_w"))
    band = band.withColumn("bw", F.greatest(F.lit(1.0), F.col("br") - F.col("bx")).cast("int"))
    inside = boxes.select("page_index", *"xywh").join(band, "page_index")
    x0 = F.greatest(F.lit(0.0), F.col("x") - F.col("bx")).cast("int")
    x1 = F.least(F.col("x") + F.col("w") - F.col("bx"), F.col("bw").cast("double")).cast("int")
    event = lambda at, ink: F.struct(at.alias("c"), ink.alias("ink"))
    # every box tells the page's borders, too: with a union Spark would no longer know the rows to be dealt by page
    ends = inside.where(x1 > x0).select("page_index", F.inline(F.array(event(x0, F.col("h")), event(x1, -F.col("h")), event(F.lit(0), F.lit(0.0)), event(F.col("bw"), F.lit(0.0)))))
    at = ends.groupBy("page_index", "c").agg(F.sum("ink").alias("ink")).join(band.select("page_index", "bx", "bw", (F.col("bb") - F.col("by")).alias("bh"), "least_w"), "page_index")
    order = page.orderBy("c")
    level = F.sum("ink").over(order.rowsBetween(Window.unboundedPreceding, 0))
    steps = at.withColumn("white", (F.col("c") < F.col("bw")) & (level <= max_cover * F.col("bh"))).withColumn("next", F.lead("c").over(order))
    begins = F.col("white") & ~F.coalesce(F.lag("white").over(order), F.lit(False))
    runs = steps.withColumn("run", F.sum(begins.cast("int")).over(order.rowsBetween(Window.unboundedPreceding, 0))).where("white")
    runs = runs.groupBy("page_index", "bx", "bw", "least_w", "run").agg(F.min("c").alias("c0"), F.max("next").alias("c1"))
    found = runs.where((F.col("c1") - F.col("c0") >= F.col("least_w")) & (F.col("c0") > 0) & (F.col("c1") < F.col("bw"))).select("page_index", (F.col("bx") + F.col("c0")).alias("x0"), (F.col("bx") + F.col("c1")).alias("x1"))
    sides = found.join(boxes.select("page_index", "x", "w"), "page_index").groupBy("page_index", "x0", "x1").agg(F.count_if(F.col("x") + F.col("w") <= F.col("x0")).alias("left"), F.count_if(F.col("x") >= F.col("x1")).alias("right"))
    return sides.where((F.col("left") >= least) & (F.col("right") >= least)).select("page_index", "x0", "x1")


def union_boxes(boxes: DataFrame, *keys: str) -> DataFrame:
    """Per key the union of non-empty boxes, their number and mean height."""
    full = boxes.where("w > 0 AND h > 0").groupBy(*keys).agg(F.min("x").alias("x"), F.min("y").alias("y"), F.max(F.col("x") + F.col("w")).alias("_r"), F.max(F.col("y") + F.col("h")).alias("_b"), F.count("*").alias("count"), (F.sum("h") / F.count("*")).alias("mean_h"))
    return full.select(*keys, "x", "y", (F.col("_r") - F.col("x")).alias("w"), (F.col("_b") - F.col("y")).alias("h"), "count", "mean_h")


def _sided(boxes: DataFrame, gap: float | str, mids: bool) -> DataFrame:
    """``boxes`` with _gap, and with _mids: the middles of the page's gutters, in order (the column ``mids``, or none)."""
    wide = F.col(gap) if isinstance(gap, str) else F.lit(float(gap))
    none = F.array().cast("array<double>")
    return boxes.withColumn("_gap", wide).withColumn("_mids", F.coalesce("mids", none) if mids else none)


def _side(pdf):
    """Between which gutters each box has its centre: boxes with different sides lie across a gutter's middle."""
    import numpy as np

    return np.searchsorted(np.asarray(pdf._mids.iloc[0], float), (pdf.x + pdf.w / 2).to_numpy(), side="right")


class Groups:
    """Places 0 to n - 1 in groups, named by their least."""

    def __init__(self, n: int):
        self.root = list(range(n))

    def top(self, i: int) -> int:
        while self.root[i] != i:
            self.root[i] = self.root[self.root[i]]
            i = self.root[i]
        return i

    def tie(self, a: int, b: int) -> None:
        a, b = self.top(a), self.top(b)
        self.root[max(a, b)] = min(a, b)


#: Pairs of boxes that are compared at once.
PAIRS = 1_000_000


def united(root: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """``root`` (of each place the least of its group) after a[i] and b[i] have been put into one group for each i."""
    while True:
        low, high = np.minimum(root[a], root[b]), np.maximum(root[a], root[b])
        if not len(apart := np.flatnonzero(low != high)):
            return root
        a, b = a[apart], b[apart]
        np.minimum.at(root, high[apart], low[apart])
        while (root[root] != root).any():
            root = root[root]


def joined_boxes(page: np.ndarray, side: np.ndarray, far: np.ndarray, seq: np.ndarray, x: np.ndarray, y: np.ndarray, w: np.ndarray, h: np.ndarray, overlap: float, reach: float) -> np.ndarray:
    """For each box the least seq of those that it is joined with. Boxes meet in bands of their page, some as high as a usual box, by x."""
    n = len(page)
    order = np.lexsort((seq, x, page))
    page, side, far, seq, x, y, h, r, b = (c[order] for c in (page, side, far, seq, x, y, h, x + w, y + h))
    band = max(float(np.median(h)), float(b.max() - y.min()) / (8 * n**0.5 + 100), 1e-9)
    top = np.floor((y - y.min()) / band).astype(np.int64)
    many = np.maximum(np.floor((b - y.min()) / band).astype(np.int64) - top, 0) + 1
    box = np.repeat(np.arange(n), many)
    cell = np.repeat(top - np.cumsum(many) + many, many) + np.arange(len(box))
    cell += page[box] * (int(cell.max()) + 1)
    box = box[np.lexsort((box, cell))]  # by band, then as sorted above
    cell = np.sort(cell)
    # a place for a box's right end among its band's left ends: rounded up, decided exactly below
    wide = float(r.max() - x.min()) + 1.0 + min(reach, float(far.max()))
    until = np.minimum(x[box] - x.min(), wide) / wide
    asked = np.clip((r[box] + np.minimum(reach, far[box]) - x.min()) / wide, 0, 1)
    turn = np.unique(cell, return_inverse=True)[1].astype(float) * 2
    count = np.maximum(np.searchsorted(turn + until, turn + asked + 1e-9 * (turn + 1), side="right") - np.arange(len(box)) - 1, 0)
    root, ends, at = np.arange(n), np.cumsum(count), 0
    while at < len(box):
        to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + PAIRS)))
        own = count[at:to]
        first = np.repeat(np.arange(at, to), own)
        second = first + 1 + np.arange(len(first)) - np.repeat(np.cumsum(own) - own, own)
        same = cell[first] == cell[second]
        i, j = box[first[same]], box[second[same]]
        rows = np.minimum(b[j], b[i]) - np.maximum(y[j], y[i])
        near = (rows >= overlap * np.minimum(h[j], h[i])) & (x[j] <= r[i] + np.minimum(reach, far[i])) & (x[j] - r[i] <= far[i]) & (side[i] == side[j])
        root, at = united(root, i[near], j[near]), to
    least = seq.copy()
    np.minimum.at(least, root, seq)
    out = np.empty(n, np.int64)
    out[order] = least[root]
    return out


def clusters(boxes: DataFrame, gap: float | str, overlap: float = 0.5, reach: float = 200.0, mids: bool = False, boxed: bool = False) -> DataFrame:
    """page_index, seq, cluster (with ``boxed`` the boxes, too): boxes joined when their rows overlap by half and their gap is small, transitively; with ``mids``, never across a gutter.

    A page's boxes are one row; a batch of pages is swept by x at once, each box against those that still reach it.
    """

    def found(boxes: pa.Array, gap: pa.Array, mids: pa.Array) -> pa.Array:
        own, all_boxes = pc.list_value_length(boxes).to_numpy(), boxes.flatten()
        page = np.repeat(np.arange(len(boxes)), own)
        seq, x, y, w, h = (all_boxes.field(c).to_numpy() for c in ("seq", *"xywh"))
        side = np.zeros(len(page), np.int64)
        for k in np.flatnonzero(pc.list_value_length(mids).to_numpy()):
            to = slice(own[:k].sum(), own[: k + 1].sum())
            side[to] = np.searchsorted(np.asarray(mids[k].as_py(), float), x[to] + w[to] / 2, side="right")
        cluster = joined_boxes(page, side, gap.to_numpy()[page], seq, x, y, w, h, overlap, reach) if len(page) else seq
        fields = {"seq": seq, "cluster": cluster} | ({"x": x, "y": y, "w": w, "h": h} if boxed else {})
        ends = np.concatenate([[0], np.cumsum(own)]).astype(np.int32)
        return pa.ListArray.from_arrays(pa.array(ends), pa.StructArray.from_arrays([pa.array(c) for c in fields.values()], list(fields)))

    given = _sided(boxes, gap, mids).groupBy("page_index").agg(F.collect_list(F.struct(F.col("seq").cast("long").alias("seq"), *(F.col(c).cast("double").alias(c) for c in "xywh"))).alias("_boxes"), F.first("_gap").alias("_gap"), F.first("_mids").alias("_mids"))
    swept = F.arrow_udf(found, "array<struct<seq:bigint,cluster:bigint" + ",x:double,y:double,w:double,h:double" * boxed + ">>")
    return given.select("page_index", swept("_boxes", "_gap", "_mids").alias("_found")).select("page_index", F.inline("_found"))


def merge_stacked(blocks: DataFrame, gap: float | str, mids: bool = False) -> DataFrame:
    """page_index, block, into: blocks from the top down join the latest kept block that lies just above and overlaps half; with ``mids``, on the same side of every gutter.

    A fold in order, so a page at a time.
    """
    import pandas as pd

    def page(pdf: pd.DataFrame) -> pd.DataFrame:
        from bisect import bisect_right

        kept: list[list] = []
        into = []
        pdf = pdf.sort_values(["y", "block"])
        far, middles = float(pdf._gap.iloc[0]), list(pdf._mids.iloc[0])
        side = lambda k: bisect_right(middles, (k[0] + k[2]) / 2)
        for row in pdf.itertuples():
            box = [row.x, row.y, row.x + row.w, row.y + row.h, row.block]
            for k in reversed(kept):
                v_gap = max(box[1] - k[3], k[1] - box[3], 0.0)
                h_over = max(min(k[2], box[2]) - max(k[0], box[0]), 0.0)
                if v_gap <= far and h_over >= 0.5 * min(k[2] - k[0], row.w) and side(k) == side(box):
                    k[:4] = [min(k[0], box[0]), min(k[1], box[1]), max(k[2], box[2]), max(k[3], box[3])]
                    into.append(k[4])
                    break
            else:
                kept.append(box)
                into.append(row.block)
        return pd.DataFrame({"page_index": pdf.page_index, "block": pdf.block, "into": into})

    given = _sided(blocks, gap, mids).select("page_index", "block", *"xywh", "_gap", "_mids")
    return given.groupBy("page_index").applyInPandas(page, "page_index long, block long, into long")


def rows_of_lines(lines: DataFrame, h: float) -> DataFrame:
    """page_index, line_no, row: lines from the top whose centre is within half a height of the growing row's."""
    import pandas as pd

    def page(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["y", "line_no"])
        row, top, low, out = -1, 0.0, 0.0, []
        for y, height in zip(pdf.y, pdf.h, strict=True):
            if row >= 0 and abs((top + low) / 2 - (y + height / 2)) < 0.5 * h:
                top, low = min(top, y), max(low, y + height)
            else:
                row, top, low = row + 1, y, y + height
            out.append(row)
        return pd.DataFrame({"page_index": pdf.page_index, "line_no": pdf.line_no, "row": out})

    return lines.select("page_index", "line_no", "y", "h").groupBy("page_index").applyInPandas(page, "page_index long, line_no long, row long")


def upper_median(value: Column) -> Column:
    """The middle value, the upper one of two; 0 of none."""
    values = F.sort_array(F.collect_list(value))
    return F.coalesce(F.get(values, F.floor(F.size(values) / 2).cast("int")), F.lit(0.0))


def text_height(boxes: DataFrame) -> DataFrame:
    medium = F.when((F.col("h") >= 4) & (F.col("h") <= 60) & (F.col("w") <= 80), F.col("h"))
    return boxes.groupBy("page_index").agg(F.greatest(upper_median(medium), F.lit(4.0)).alias("text_height"))


def classify(blocks: DataFrame, rules: DataFrame, page_w: float, page_h: float, h: float | Column) -> DataFrame:
    """Blocks (page_index, block, x, y, w, h, count, mean_h) with kind and class_score, from each page's main columns (mx0, mx1, my0, my1: null without any) and
    the separators (page_index, y) above them. ``h``: the height of text."""
    page = Window.partitionBy("page_index")
    b = blocks.withColumn("widest", F.max("w").over(page))
    main = (F.col("w") >= 0.6 * F.col("widest")) & (F.col("count") >= 3)
    for name, value in (("mx0", F.min(F.when(main, F.col("x")))), ("mx1", F.max(F.when(main, F.col("x") + F.col("w")))), ("my0", F.min(F.when(main, F.col("y")))), ("my1", F.max(F.when(main, F.col("y") + F.col("h"))))):
        b = b.withColumn(name, value.over(page))
    near = rules.groupBy("page_index").agg(F.collect_set("y").alias("rules"))
    b = b.join(near, "page_index", "left")
    x, y, w, r, low = F.col("x"), F.col("y"), F.col("w"), F.col("x") + F.col("w"), F.col("y") + F.col("h")
    has = F.col("mx0").isNotNull()
    yes = lambda c: F.coalesce(c, F.lit(False))
    inside = yes((x >= F.col("mx0") - 2 * h) & (r <= F.col("mx1") + 2 * h))
    outside = yes((r <= F.col("mx0") - 0.5 * h) | (x >= F.col("mx1") + 0.5 * h))
    short, small = F.col("count") <= 2, F.col("mean_h") < 0.88 * h
    ruled = F.exists(F.coalesce("rules", F.array().cast("array<double>")), lambda s: (s < y) & (s > F.col("my0")) & (y - s < 6 * h))
    top = (y < 0.12 * page_h) & short & (~has | yes(low <= F.col("my0") + h))
    end = (low > 0.9 * page_h) & short & (~has | yes(y >= F.col("my1") - h))
    heading = inside & ((F.col("mean_h") > 1.25 * h) | ((w < 0.7 * F.col("widest")) & (F.col("count") <= 3) & yes(y < F.col("my0") + h)))
    kind = (
        F.when(top, F.when(w < 3 * h, "page_number").otherwise("header"))
        .when(end, F.when((w < 5 * h) & F.coalesce(r >= F.col("mx1") - 4 * h, F.lit(True)), "catchword").otherwise("footer"))
        .when(outside & (w < 0.35 * page_w), "marginalia")
        .when(inside & small & (yes(y >= F.col("my1") - h) | yes(ruled)), "footnote")
        .when(heading, "heading")
        .when(inside | ~has, "body")
        .otherwise("uncertain")
    )
    score = F.when(kind.isin("body", "header", "marginalia", "footnote"), 0.9).when(kind == "uncertain", 0.3).otherwise(0.7)
    return b.withColumn("kind", kind).withColumn("class_score", score).drop("widest", "rules")


def coverage(words: DataFrame, regions: DataFrame, page_w: float, page_h: float, edge: float = 2.0) -> DataFrame:
    """Per page: words, words not half inside a text region, regions at the page's edge, and a warning above 5 %."""
    w, r = words.where("text <> ''").alias("w"), regions.where(~F.col("kind").isin(*NOT_TEXT)).alias("r")
    lost = w.join(r, (F.col("w.page_index") == F.col("r.page_index")) & (G.overlap_fraction(box("w"), box("r")) >= 0.5), "left_anti").groupBy("page_index").agg(F.count("*").alias("words_uncovered"))
    total = w.groupBy("page_index").agg(F.count("*").alias("words_total"))
    at_edge = (F.col("x") <= edge) | (F.col("y") <= edge) | (F.col("x") + F.col("w") >= page_w - edge) | (F.col("y") + F.col("h") >= page_h - edge)
    clipped = regions.groupBy("page_index").agg(F.count_if(at_edge).alias("clipped_regions"))
    out = total.join(lost, "page_index", "left").join(clipped, "page_index", "left").fillna(0)
    return out.withColumn("warning", 20 * F.col("words_uncovered") > F.col("words_total"))


def split_regions(regions: DataFrame, at: float | Column, margin: float = 2.0) -> DataFrame:
    """Regions that a horizontal line crosses inside become two; the lower part is new. No line where ``at`` is null."""
    at = at if isinstance(at, Column) else F.lit(at)
    cut = F.coalesce((F.col("y") + margin < at) & (F.col("y") + F.col("h") - margin > at), F.lit(False))
    rest = [c for c in regions.columns if c not in ("y", "h")]
    parts = F.when(cut, F.array(F.struct(F.lit(0).alias("part"), F.col("y").alias("y"), (at - F.col("y")).alias("h")), F.struct(F.lit(1).alias("part"), at.alias("y"), (F.col("y") + F.col("h") - at).alias("h")))).otherwise(F.array(F.struct(F.lit(0).alias("part"), "y", "h")))
    return regions.select(*rest, F.inline(parts))


#: Gaps inside a line, between the lines of a block and between body blocks that are one, in heights of text; a separator is over so many
#: heights long and at most so many points thick.
LINE_GAP, BLOCK_GAP, BODY_GAP, RULE_LONG, RULE_THICK = 1.6, 1.3, 3.0, 3.0, 3.0


def blocks_of(lines: DataFrame) -> DataFrame:
    """page_index, seq, block: lines (seq, box, _gap, _mids, text_height, page_h) stacked closely and overlapping are a block, on one side of every gutter. A
    block is cut at gaps far above its own, below a running head and above a last line at the page's foot. Blocks are named by their least line.

    Order and gaps of rows decide, so a page at a time.
    """
    import numpy as np
    import pandas as pd

    middle = lambda v: sorted(v)[len(v) // 2] if len(v) else 0.0

    def cuts(rows: list[list[float]], h: float, page_h: float) -> list[bool]:
        """After which rows (x0, y0, x1, y1) a block ends."""
        gaps = [max(b[1] - a[3], 0.0) for a, b in zip(rows, rows[1:], strict=False)]
        out = [g > max(2.5 * middle(gaps), 1.4 * h) for g in gaps]
        width = max(r[2] - r[0] for r in rows)
        if len(rows) >= 4 and rows[0][1] < 0.12 * page_h:
            out[0] |= gaps[0] >= 1.5 * max(middle(gaps[1:]), 1.0) or rows[0][2] - rows[0][0] <= 0.8 * width
        if len(rows) >= 4 and rows[-1][3] > 0.9 * page_h:
            out[-1] |= rows[-1][2] - rows[-1][0] <= 0.6 * width
        return out

    def page(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["y", "seq"]).reset_index(drop=True)
        x, y, r, b, w = pdf.x.to_numpy(), pdf.y.to_numpy(), (pdf.x + pdf.w).to_numpy(), (pdf.y + pdf.h).to_numpy(), pdf.w.to_numpy()
        far, h, page_h = float(pdf._gap.iloc[0]), float(pdf.text_height.iloc[0]), float(pdf.page_h.iloc[0])
        side, groups = _side(pdf), Groups(len(pdf))
        for i in range(len(pdf)):
            near = np.arange(i + 1, np.searchsorted(y, b[i] + far, side="right"))
            over = np.maximum(np.minimum(r[near], r[i]) - np.maximum(x[near], x[i]), 0.0)
            for j in near[(over >= 0.3 * np.minimum(w[near], w[i])) & (side[near] == side[i])]:
                groups.tie(i, int(j))
        members: dict[int, list[int]] = {}
        for i in range(len(pdf)):
            members.setdefault(groups.top(i), []).append(i)
        block = np.zeros(len(pdf), np.int64)
        for own in members.values():
            rows, row_of = [], []
            for i in own:
                if rows and abs((rows[-1][1] + rows[-1][3]) / 2 - (y[i] + b[i]) / 2) < 0.5 * h:
                    a = rows[-1]
                    rows[-1] = [min(a[0], x[i]), min(a[1], y[i]), max(a[2], r[i]), max(a[3], b[i])]
                else:
                    rows.append([x[i], y[i], r[i], b[i]])
                row_of.append(len(rows) - 1)
            part = np.concatenate([[0], np.cumsum(cuts(rows, h, page_h))]).astype(int)
            of = part[row_of]
            for k in set(of.tolist()):
                ids = [i for i, p in zip(own, of, strict=True) if p == k]
                block[ids] = min(int(pdf.seq.iloc[i]) for i in ids)
        return pd.DataFrame({"page_index": pdf.page_index, "seq": pdf.seq, "block": block})

    return lines.groupBy("page_index").applyInPandas(page, "page_index long, seq long, block long")


def analyze(components: DataFrame, page_w: float, page_h: float, parts: int | None = None) -> DataFrame:
    """Ink components (page_index, seq, box) to regions: page_index, block, kind, column, box, line_count, class_score and reading_order.

    Long thin components are separators. The others show the gutters, over which neither lines nor blocks reach; lines become blocks, blocks classes; body
    blocks that stack are one region, in the column that the gutters inside the main text give it. Boxes are padded by a quarter of the text's height.
    ``parts``: into how many parts the components are dealt by page.
    """
    heights = stored(dealt(text_height(components), parts), "heights", parts)
    sized = components.join(heights, "page_index")
    rule = (F.col("w") > RULE_LONG * F.col("text_height")) & (F.col("h") <= RULE_THICK)
    rules, glyphs = stored(sized.where(rule).select("page_index", "y"), "rules"), sized.where(~rule).withColumn("_white", 0.4 * F.col("text_height"))
    white = stored(dealt(gutters(glyphs, "_white"), parts), "gutters", parts)
    per_page = white.groupBy("page_index").agg(F.sort_array(F.collect_list((F.col("x0") + F.col("x1")) / 2)).alias("mids"), F.sort_array(F.collect_list(F.struct("x0", "x1"))).alias("gutters"))  # a page's gutters
    glyphs = glyphs.join(per_page.select("page_index", "mids"), "page_index", "left").withColumn("_near", LINE_GAP * F.col("text_height"))
    grouped = clusters(glyphs, "_near", mids=True, boxed=True)  # united where they are made: only lines are shuffled
    lines = union_boxes(grouped, "page_index", "cluster").withColumnRenamed("cluster", "seq").join(heights, "page_index")
    lines = lines.where((F.col("count") >= 2) | (F.col("w") >= F.col("text_height"))).join(per_page, "page_index", "left").withColumn("_near", BLOCK_GAP * F.col("text_height")).withColumn("page_h", F.lit(page_h))
    lines = stored(_sided(lines, "_near", True).drop("_near"), "lines")
    of = blocks_of(lines.select("page_index", "seq", *"xywh", "_gap", "_mids", "text_height", "page_h"))
    b = lines.join(of, ["page_index", "seq"]).groupBy("page_index", "block", "text_height", "mids", "gutters").agg(
        F.min("x").alias("x"), F.min("y").alias("y"), F.max(F.col("x") + F.col("w")).alias("_r"), F.max(F.col("y") + F.col("h")).alias("_b"), F.count(F.lit(1)).alias("count"), F.avg("mean_h").alias("mean_h"),
    )
    b = b.withColumn("w", F.col("_r") - F.col("x")).withColumn("h", F.col("_b") - F.col("y")).drop("_r", "_b")
    classed = stored(classify(b, rules.select("page_index", "y"), page_w, page_h, F.col("text_height")), "classed")
    body = classed.where("kind = 'body'").withColumn("_far", BODY_GAP * F.col("text_height"))
    into = merge_stacked(body, "_far", mids=True)
    m = classed.join(into, ["page_index", "block"], "left").withColumn("into", F.coalesce("into", "block"))
    first = lambda c: F.min_by(c, F.struct("y", "block")).alias(c)
    m = m.groupBy("page_index", F.col("into").alias("block")).agg(
        *(first(c) for c in ("kind", "class_score", "text_height", "gutters", "mx0", "mx1")), F.min("x").alias("x"), F.min("y").alias("y"), F.max(F.col("x") + F.col("w")).alias("_r"), F.max(F.col("y") + F.col("h")).alias("_b"), F.sum("count").alias("line_count"),
    )
    t = F.col("text_height")
    inner = F.filter(F.coalesce("gutters", F.array().cast("array<struct<x0:double,x1:double>>")), lambda g: (g["x0"] > F.col("mx0") + t) & (g["x1"] < F.col("mx1") - t))
    column = F.when((F.col("kind") == "body") & (F.size(inner) > 0), F.size(F.filter(inner, lambda g: F.col("x") >= g["x0"]))).cast("long")
    m = m.withColumn("column", column)
    pad = 0.25 * t
    x0, y0, x1, y1 = F.greatest(F.col("x") - pad, F.lit(0.0)), F.greatest(F.col("y") - pad, F.lit(0.0)), F.least(F.col("_r") + pad, F.lit(page_w)), F.least(F.col("_b") + pad, F.lit(page_h))
    m = m.select("page_index", "block", "kind", "column", "class_score", "line_count", x0.alias("x"), y0.alias("y"), (x1 - x0).alias("w"), (y1 - y0).alias("h"))
    return reading_order(m.withColumn("region_id", F.col("block"))).drop("region_id")
