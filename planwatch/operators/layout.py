"""Price grids from the words of pages: lines, band labels, the prices beside them, tables and columns.

Words are rows (doc, page, text, x0, x1, top, base). All but lines is joins and windows within a page. A line depends on the mean of the words
assigned to it before and goes through Python, page by page; a page is small.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from planwatch.functions.tags import condition_tags
from planwatch.functions.text import band_of_label, fold, money, registration, without_currency
from planwatch.session import written

PAGE = ["doc", "page"]
TASK = 250_000  # words that a task gets
TOLERANCE = 2.5  # points between a word and the running mean of its line
ALIGNED = 25  # points between the labels of one table
STRETCH = 3.5  # times the usual step that a table may skip for each band
HEAD = 8  # bands that the head of a transposed table names at least
#: How the words begin that tell a table's condition in its heading.
HEADING_WORDS = ("tabela", "vidas", "copartic", "adesao", "pme", "mei", "empresarial", "vigencia", "regiao", "capital", "interior", "porte", "grupo", "compuls", "familiar", "titular", "dependente")


def dealt(table: DataFrame, task: int | None = None, by: list[str] = PAGE, words: int = 1) -> DataFrame:
    """A written table by pages, or by other columns, about ``task`` (TASK) words a task, ``words`` to a row: they shrink so much in a shuffle that tasks by its size would hold too many of them."""
    tasks = max(table.sparkSession.sparkContext.defaultParallelism, -(-table.count() * words // (task or TASK)))
    return table.repartition(tasks, *by)


def lines(words: DataFrame) -> DataFrame:
    """``words`` with line (from 0, downwards) and place (from 0, rightwards). A word joins the last line if it is close to the mean of
    that line's words so far; one without a height joins the last line.

    Pages are dealt as they hash and read one behind the other, word by word, so a task holds no more than a batch."""
    ordered = [F.asc_nulls_last(c) for c in ("_yc", "x0", "text")]
    dealt = words.withColumn("_yc", (F.col("top") + F.col("base")) / 2).repartition(*PAGE).sortWithinPartitions(*PAGE, *ordered)

    def assign(batches):
        page, line, mean, n = object(), 0, None, 0
        for batch in batches:
            numbers = []
            for *at, y in zip(*(batch.column(c).to_pylist() for c in (*PAGE, "_yc"))):
                if at != page:
                    page, line, mean, n = at, 0, y, 1
                elif y is not None and abs(mean - y) > TOLERANCE:
                    line, mean, n = line + 1, y, 1
                elif y is not None:
                    n += 1
                    mean += (y - mean) / n
                numbers.append(line)
            yield batch.append_column("line", pa.array(numbers, pa.int32()))

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in dealt.schema) + ", line int"
    across = W.partitionBy(*PAGE, "line").orderBy(*ordered[1:])
    return dealt.mapInArrow(assign, schema).drop("_yc").withColumn("place", F.row_number().over(across) - 1)


def whole_amounts(words: DataFrame, gap: float = 2.5, slope: float = 3.0) -> DataFrame:
    """``words`` with the pieces of amounts that a scan parts at the comma joined again, however many: (doc, page, text, x0, x1, top, base).

    A piece belongs to the one before it on the page, by height in steps of ``slope`` and then from left to right, if their heights differ by less than ``slope``, the
    way between them is 0 to ``gap``, and a comma starts the one or ends the other. Runs of such pieces are islands; of a run the texts are joined and the
    boxes are one around all. A run is one line's, so no group grows with the data. Words that come ``dealt`` by document or page stay in
    their tasks, where they are sorted once."""
    y = (F.col("top") + F.col("base")) / 2
    w = W.partitionBy(*PAGE).orderBy("_step", "x0", "text")
    stepped = words.withColumn("_step", F.bround(y / slope))
    held = F.coalesce((F.abs(y - F.lag(y).over(w)) < slope) & (F.col("x0") - F.lag("x1").over(w)).between(0, gap) & (F.col("x0") - F.lag("x1").over(w) < gap) & (F.startswith("text", F.lit(",")) | F.endswith(F.lag("text").over(w), F.lit(","))), F.lit(False))
    placed = stepped.select(*PAGE, "text", "x0", "x1", "top", "base", "_step", (~held).cast("int").alias("_new"), F.row_number().over(w).alias("_n"))
    runs = placed.withColumn("_run", F.sum("_new").over(w.rowsBetween(W.unboundedPreceding, 0)))
    joined = runs.groupBy(*PAGE, "_run").agg(F.array_sort(F.collect_list(F.struct("_n", "text", "x1"))).alias("_p"), F.min_by("x0", "_n").alias("x0"), F.min("top").alias("top"), F.max("base").alias("base"))
    return joined.select(*PAGE, F.array_join("_p.text", "").alias("text"), "x0", F.element_at("_p.x1", -1).alias("x1"), "top", "base")


def amounts(lined: DataFrame) -> DataFrame:
    """(doc, page, line, place, x0, x1, xc, yc, price) of the words that are amounts. Digits that a file draws apart, touching the amount behind
    them, belong to it where both together are an amount."""
    w = W.partitionBy(*PAGE, "line").orderBy("place")
    own = without_currency(F.col("text"))
    before, end = F.lag("text").over(w), F.lag("x1").over(w)
    glued = F.concat(before, own)
    groups = F.split(before, r"\.")
    thousands = F.forall(groups, lambda g: F.translate(g, "0123456789", "") == "") & F.length(F.get(groups, F.lit(0))).between(1, 3) & F.forall(F.slice(groups, F.lit(2), F.greatest(F.size(groups) - 2, F.lit(0))), lambda g: F.length(g) == 3) & ((F.size(groups) == 1) | F.length(F.element_at(groups, -1)).isin(0, 3))
    joins = thousands & (F.abs(F.col("x0") - end) <= 1) & money(glued).isNotNull()
    rows = lined.withColumns({"_joins": F.coalesce(joins, F.lit(False)), "_glued": glued, "_x0": F.lag("x0").over(w), "_own": own}).where(money(own).isNotNull())
    x0 = F.when(F.col("_joins"), F.col("_x0")).otherwise(F.col("x0"))
    price = money(F.when(F.col("_joins"), F.col("_glued")).otherwise(F.col("_own")))
    return rows.select(*PAGE, "line", "place", x0.alias("x0"), "x1", ((x0 + F.col("x1")) / 2).alias("xc"), ((F.col("top") + F.col("base")) / 2).alias("yc"), price.alias("price"))


def labels(lined: DataFrame, longest: int = 4) -> DataFrame:
    """(doc, page, line, place, band, x0, x1, y, height, head): band labels of one to ``longest`` words, of overlapping ones the one that starts
    first and is shortest, so that a price behind it isn't taken for a part of it. head: the line names eight bands and no price, as the head of
    a transposed table does."""
    w = W.partitionBy(*PAGE, "line").orderBy("place")
    following = [F.lead(F.struct("text", "x1"), i).over(w) for i in range(1, longest)]
    rows = lined.select(*PAGE, "line", "place", "x0", "x1", "text", ((F.col("top") + F.col("base")) / 2).alias("y"), (F.col("base") - F.col("top")).alias("height"), *[f.alias(f"n{i}") for i, f in enumerate(following, 1)])
    texts = [F.concat_ws(" ", "text", *[F.col(f"n{j}.text") for j in range(1, i + 1)]) for i in range(longest)]
    ends = ["x1", *[f"n{i}.x1" for i in range(1, longest)]]
    options = F.array(*[F.struct(F.lit(i + 1).alias("size"), t.alias("label"), F.col(e).alias("end")) for i, (t, e) in enumerate(zip(texts, ends))])
    own = [*PAGE, "line", "place", "x0", "y", "height"]
    spread = rows.select(*own, F.inline(options)).where("end is not null").where(F.col("label").rlike("[0-9]"))
    known = spread.select("label").distinct().withColumn("band", band_of_label(F.col("label"))).where("band is not null")  # each different text is read once
    known = written(known, "known-labels")  # few, whatever many texts were read for them
    best = spread.join(known, "label").groupBy(*own).agg(F.min(F.struct("size", "band", "end")).alias("b"))
    found = best.withColumn("before", F.max(F.col("place") + F.col("b.size")).over(w.rowsBetween(W.unboundedPreceding, -1))).where("before is null or place >= before")
    priced = lined.groupBy(*PAGE, "line").agg(F.bool_or(money(without_currency(F.col("text"))).isNotNull()).alias("priced"))
    named = found.withColumn("named", F.size(F.collect_set("b.band").over(W.partitionBy(*PAGE, "line"))))
    head = (F.col("named") >= HEAD) & ~F.col("priced")
    return named.join(priced, [*PAGE, "line"]).select(*PAGE, "line", "place", F.col("b.band").alias("band"), "x0", F.col("b.end").alias("x1"), "y", "height", head.alias("head"))


def segments(lined: DataFrame) -> DataFrame:
    """(doc, page, band, label_x, y, xs, prices): for each label the prices to its right at its height, up to the next label at that height."""
    a = written(labels(lined), "labels").where("not head").withColumn("reach", F.greatest(F.lit(TOLERANCE), 0.6 * F.col("height"))).withColumn("id", F.struct("line", "x0"))
    b = a.select(*PAGE, F.col("x0").alias("bx"), F.col("y").alias("by"))
    bound = a.join(b, PAGE).where((F.col("bx") > F.col("x1")) & (F.abs(F.col("by") - F.col("y")) <= F.col("reach"))).groupBy(*PAGE, "id").agg(F.min("bx").alias("bound"))
    m = amounts(lined).select(*PAGE, "xc", "yc", "price")
    near = (F.col("xc") > F.col("x1")) & (F.abs(F.col("yc") - F.col("y")) <= F.col("reach")) & (F.col("bound").isNull() | (F.col("xc") < F.col("bound")))
    hit = a.join(bound, [*PAGE, "id"], "left").join(m, PAGE).where(near)
    listed = hit.groupBy(*PAGE, "id", "band", "y").agg(F.array_sort(F.collect_list(F.struct("xc", "price"))).alias("v"))
    return listed.select(*PAGE, "band", F.col("id.x0").alias("label_x"), "y", F.col("v.xc").alias("xs"), F.col("v.price").cast("array<double>").alias("prices"))


def stacked(found: DataFrame) -> DataFrame:
    """Segments with the number of their table on the page. Labels that lie above each other make a stack; in a stack a table ends where the
    band doesn't rise or the way down is over STRETCH times the stack's usual step for each band. A table has three segments at least."""
    across = W.partitionBy(*PAGE).orderBy("label_x", "y")
    apart = F.coalesce(F.col("label_x") - F.lag("label_x").over(across) > ALIGNED, F.lit(False))
    stack = found.withColumn("_apart", apart.cast("int")).withColumn("_stack", F.sum("_apart").over(across.rowsBetween(W.unboundedPreceding, 0)))
    down = W.partitionBy(*PAGE, "_stack").orderBy("y", "band")
    bands, way = F.col("band") - F.lag("band").over(down), F.col("y") - F.lag("y").over(down)
    stepped = stack.withColumns({"_bands": bands, "_way": way}).withColumn("_step", F.when(F.col("_bands") > 0, F.col("_way") / F.col("_bands")))
    usual = F.greatest(F.coalesce(F.median("_step").over(W.partitionBy(*PAGE, "_stack")), F.lit(30.0)), F.lit(6.0))
    ends = F.coalesce((F.col("_bands") <= 0) | (F.col("_way") > STRETCH * F.col("_usual") * F.col("_bands")), F.lit(False))
    parted = stepped.withColumn("_usual", usual).withColumn("_ends", ends.cast("int")).withColumn("_part", F.sum("_ends").over(down.rowsBetween(W.unboundedPreceding, 0)))
    own = W.partitionBy(*PAGE, "_stack", "_part")
    whole = parted.withColumns({"_n": F.count("*").over(own), "_first": F.min(F.struct("y", "label_x")).over(own)}).where("_n >= 3")
    number = F.dense_rank().over(W.partitionBy(*PAGE).orderBy("_first")) - 1
    return whole.withColumn("table", number).drop(*[c for c in whole.columns if c.startswith("_")])


def grids(words: DataFrame) -> DataFrame:
    """(doc, page, table, column, band, price). A table's columns are those of its most common number of prices, of equally common ones the
    topmost, at the median of their places; each price goes to the nearest column, the leftmost of several."""
    tables = stacked(segments(dealt(written(lines(words), "lines"))))
    key = [*PAGE, "table"]
    width = tables.groupBy(*key, F.size("xs").alias("width")).agg(F.count("*").alias("n"), F.min("y").alias("top")).groupBy(*key).agg(F.min_by("width", F.struct(-F.col("n"), F.col("top"))).alias("width"))
    spread = tables.join(width, key)
    centres = spread.where(F.size("xs") == F.col("width")).select(*key, F.posexplode("xs").alias("column", "x")).groupBy(*key, "column").agg(F.median("x").alias("centre"))
    each = spread.select(*key, "band", "y", F.explode(F.arrays_zip("xs", "prices")).alias("v")).select(*key, "band", "y", F.col("v.xs").alias("x"), F.col("v.prices").alias("price"))
    placed = each.join(centres, key).groupBy(*key, "band", "y", "x", "price").agg(F.min_by("column", F.struct(F.abs(F.col("x") - F.col("centre")), F.col("column"))).alias("column"))
    return placed.groupBy(*key, "column", "band").agg(F.min_by("price", F.struct("y", "x")).alias("price"))


def transposed_grids(words: DataFrame, far: int = 80) -> DataFrame:
    """(doc, page, line, head, band, price, product, heading) of tables whose head names the bands and whose rows are products.

    Rows are the lines below a head, up to the next one, with five prices or more; a line with fewer over ``far`` points below the last row ends
    the table. A price belongs to the band whose centre is nearest, within 0.6 of the least step between centres, the leftmost of several.
    product is the last registration in the row, heading what stands before its first price."""
    lined = dealt(written(lines(words), "lines"))
    heads = written(labels(lined).where("head"), "heads")
    centre = heads.withColumn("centre", (F.col("x0") + F.col("x1")) / 2)
    gaps = centre.withColumn("gap", F.col("centre") - F.lag("centre").over(W.partitionBy(*PAGE, "line").orderBy("centre")))
    steps = gaps.groupBy(*PAGE, F.col("line").alias("head")).agg(F.coalesce(F.min("gap"), F.lit(40.0)).alias("step"))
    m = amounts(lined)
    y = (F.col("top") + F.col("base")) / 2
    of_line = lined.groupBy(*PAGE, "line").agg(F.min_by(y, "place").alias("y")).join(m.groupBy(*PAGE, "line").agg(F.count("*").alias("n"), F.min("x0").alias("first")), [*PAGE, "line"], "left")
    of_line = of_line.join(heads.select(*PAGE, "line", F.lit(True).alias("is_head")).distinct(), [*PAGE, "line"], "left")
    w = W.partitionBy(*PAGE).orderBy("line")
    marked = of_line.withColumn("head", F.last(F.when(F.col("is_head"), F.col("line")), ignorenulls=True).over(w)).where("head is not null")
    row = (F.coalesce("n", F.lit(0)) >= 5) & F.col("is_head").isNull()
    below = W.partitionBy(*PAGE, "head").orderBy("line")
    last = F.last(F.when(row | F.col("is_head"), F.col("y")), ignorenulls=True).over(below.rowsBetween(W.unboundedPreceding, -1))
    broken = marked.withColumn("_over", (~row & F.col("is_head").isNull() & (F.col("y") - last > far)).cast("int"))
    broken = broken.withColumn("_over", F.max("_over").over(below.rowsBetween(W.unboundedPreceding, 0)))
    rows = broken.where(row & (F.coalesce("_over", F.lit(0)) == 0)).select(*PAGE, "line", "head", "first")
    bands = centre.groupBy(*PAGE, F.col("line").alias("head")).agg(F.collect_list(F.struct("centre", "band")).alias("bands"))  # a line's labels
    near = rows.join(m.select(*PAGE, "line", "x0", "xc", "price"), [*PAGE, "line"]).join(bands.join(steps, [*PAGE, "head"]), [*PAGE, "head"])
    nearest = F.array_min(F.transform("bands", lambda b: F.struct(F.abs(F.col("xc") - b["centre"]).alias("d"), b["band"].alias("band"))))
    best = near.select(*PAGE, "line", "head", "x0", "price", "step", nearest.alias("b")).where(F.col("b.d") <= 0.6 * F.col("step"))
    cells = best.groupBy(*PAGE, "line", "head", F.col("b.band").alias("band")).agg(F.min_by("price", "x0").cast("double").alias("price"))
    number = F.when(F.col("text").rlike(r"\d{3}\.?\d{3}/\d{2}-?\d|^\d{9}$"), registration(F.col("text")))
    texts = lined.join(rows, [*PAGE, "line"]).groupBy(*PAGE, "line").agg(
        F.max_by(number, F.when(number.isNotNull(), F.col("place"))).alias("product"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("x1") <= F.col("first"), F.struct("place", "text")))), lambda t: t["text"]), " ").alias("heading"),
    )
    return cells.join(texts, [*PAGE, "line"]).select(*PAGE, "line", "head", "band", "price", "product", F.substring("heading", -80, 80).alias("heading"))


def heading_title(lines_: Column) -> Column:
    """Of the lines above a table the first two that tell its condition, each once, without those that hold a registration or are short."""
    stems = F.array(*[F.lit(f" {w}") for w in HEADING_WORDS])
    tells = lambda x: F.exists(stems, lambda s: F.contains(F.concat(F.lit(" "), F.regexp_replace(fold(x), "[^a-z0-9]+", " ")), s))
    kept = F.filter(F.array_distinct(lines_), lambda x: tells(x) & ~x.rlike(r"\b\d{3}\.?\d{3}/\d{2}-?\d\b") & (F.length(x) > 6))
    return F.left(F.array_join(F.slice(kept, 1, 2), " · "), F.lit(160))


def side_tags(words: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, tags) of words written upwards or downwards beside a table (keys, text, y): read down as they are or up with each reversed,
    whichever gives tags."""
    listed = lambda order: F.array_sort(F.collect_list(F.struct(order, F.col("text"))))
    read = words.groupBy(*keys).agg(listed(F.col("y").alias("o")).alias("down"), listed((-F.col("y")).alias("o")).alias("up"))  # a page's margin
    down = condition_tags(F.array_join(F.transform("down", lambda x: x["text"]), " "))
    up = condition_tags(F.array_join(F.transform("up", lambda x: F.reverse(x["text"])), " "))
    return read.select(*keys, F.when(F.size(down) > 0, down).otherwise(up).alias("tags"))


def needs_ocr(words: DataFrame, pages: DataFrame, least: int = 10) -> DataFrame:
    """(doc, ocr): documents with fewer than ``least`` words a page on average have no text layer to read. pages: (doc, n_pages)."""
    n = words.groupBy("doc").agg(F.count("*").alias("n"))
    return pages.join(n, "doc", "left").select("doc", (F.coalesce("n", F.lit(0)) < least * F.col("n_pages")).alias("ocr"))


def upright(words: DataFrame, angle: Column) -> DataFrame:
    """Words of a tilted scan turned back by their page's median angle (degrees), about the page's corner; boxes keep their size."""
    turned = words.withColumn("_a", angle).withColumn("_a", F.radians(F.median("_a").over(W.partitionBy(*PAGE))))
    xc, yc = (F.col("x0") + F.col("x1")) / 2, (F.col("top") + F.col("base")) / 2
    nx, ny = xc * F.cos("_a") + yc * F.sin("_a"), yc * F.cos("_a") - xc * F.sin("_a")
    half_w, half_h = (F.col("x1") - F.col("x0")) / 2, (F.col("base") - F.col("top")) / 2
    return turned.withColumns({"x0": nx - half_w, "x1": nx + half_w, "top": ny - half_h, "base": ny + half_h}).drop("_a")


def overlapping(boxes: DataFrame, least: float = 0.3, cell: int = 50) -> DataFrame:
    """(doc, page, a, b) of boxes (doc, page, id, x0, x1, top, base) that share at least ``least`` of the smaller one. Boxes meet in cells
    of the page, so only neighbours are compared."""
    span = lambda lo, hi: F.sequence(F.floor(F.col(lo) / cell), F.floor(F.col(hi) / cell))
    spread = boxes.withColumn("_i", F.explode(span("x0", "x1"))).withColumn("_j", F.explode(span("top", "base")))
    a, b = spread.alias("a"), spread.alias("b")
    on = F.lit(True)
    for c in (*PAGE, "_i", "_j"):
        on = on & (F.col(f"a.{c}") == F.col(f"b.{c}"))
    side = lambda lo, hi: F.greatest(F.lit(0.0), F.least(f"a.{hi}", f"b.{hi}") - F.greatest(f"a.{lo}", f"b.{lo}"))
    area = lambda k: (F.col(f"{k}.x1") - F.col(f"{k}.x0")) * (F.col(f"{k}.base") - F.col(f"{k}.top"))
    share = F.try_divide(side("x0", "x1") * side("top", "base"), F.least(area("a"), area("b")))
    return a.join(b, on & (F.col("a.id") < F.col("b.id"))).where(share >= least).select("a.doc", "a.page", F.col("a.id").alias("a"), F.col("b.id").alias("b")).distinct()


def drawn_over(boxes: DataFrame, least: float = 0.3) -> DataFrame:
    """The boxes (doc, page, id, text, drawn, ...) that stay: of two that overlap the one drawn later covers the other, of two with the same
    text the one drawn first stays."""
    pairs = overlapping(boxes, least)
    of = lambda k: boxes.select(*PAGE, F.col("id").alias(k), F.col("text").alias(f"{k}_text"), F.col("drawn").alias(f"{k}_drawn"))
    both = pairs.join(of("a"), [*PAGE, "a"]).join(of("b"), [*PAGE, "b"])
    a_first = F.struct("a_drawn", "a") < F.struct(F.col("b_drawn"), F.col("b"))
    same = F.col("a_text") == F.col("b_text")
    gone = F.when(a_first, F.when(same, F.col("b")).otherwise(F.col("a"))).otherwise(F.when(same, F.col("a")).otherwise(F.col("b")))
    return boxes.join(both.select(*PAGE, gone.alias("id")).distinct(), [*PAGE, "id"], "left_anti")
