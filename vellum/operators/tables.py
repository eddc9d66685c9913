"""Table markup from grid cells."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vellum.functions import headings as h
from vellum.functions import text as t

KEY = ["doc_id", "block_id"]
#: What a cell of a whole table has, and tables that a worker takes at a time.
CELL, TABLES = ("row", "col", "row_span", "col_span", "header", "text"), 256


def grid(cells: DataFrame, sizes: DataFrame) -> DataFrame:
    """A row for every place of each table (KEY, num_rows, num_cols): its cell if one starts there, and `covered` by another's span."""
    places = sizes.where("num_rows > 0 and num_cols > 0").select(*KEY, F.explode(F.sequence(F.lit(0), F.col("num_rows") - 1)).alias("row"), "num_cols")
    places = places.select(*KEY, "row", F.explode(F.sequence(F.lit(0), F.col("num_cols") - 1)).alias("col"))
    spread = cells.where("row_span > 1 or col_span > 1")
    spread = spread.withColumn("r", F.explode(F.sequence("row", F.col("row") + F.col("row_span") - 1))).withColumn("c", F.explode(F.sequence("col", F.col("col") + F.col("col_span") - 1)))
    covered = spread.where("r <> row or c <> col").select(*KEY, F.col("r").alias("row"), F.col("c").alias("col"), F.lit(True).alias("covered")).distinct()
    return places.join(cells.drop("bbox"), [*KEY, "row", "col"], "left").join(covered, [*KEY, "row", "col"], "left").withColumn("covered", F.coalesce("covered", F.lit(False)))


def ordered(value: Column, order: str) -> Column:
    """The values of a group as an array, by the column `order`."""
    return F.transform(F.sort_array(F.collect_list(F.struct(F.col(order), value.alias("v")))), lambda x: x["v"])


def html(places: DataFrame) -> DataFrame:
    """(KEY, html): spans as attributes, an empty cell where none starts, nothing where one reaches over."""
    tag = F.when(F.col("header"), "th").otherwise("td")
    span = [F.when(F.col(c) > 1, F.concat(F.lit(f' {name}="'), F.col(c), F.lit('"'))).otherwise("") for c, name in (("row_span", "rowspan"), ("col_span", "colspan"))]
    cell = F.when(F.col("covered"), "").when(F.col("row_span").isNull(), "<td></td>").otherwise(F.concat(F.lit("<"), tag, *span, F.lit(">"), "text", F.lit("</"), tag, F.lit(">")))
    rows = places.groupBy(*KEY, "row").agg(F.array_join(ordered(cell, "col"), "").alias("line"))
    return rows.groupBy(*KEY).agg(F.concat(F.lit("<table><tbody><tr>"), F.array_join(ordered(F.col("line"), "row"), "</tr><tr>"), F.lit("</tr></tbody></table>")).alias("html"))


def gfm(places: DataFrame) -> DataFrame:
    """(KEY, gfm). The header is the last of the leading rows that have a header cell, else the first row; it comes first."""
    rows = places.groupBy(*KEY, "row").agg(F.array_join(ordered(F.coalesce("text", F.lit("")), "col"), " | ").alias("line"), F.coalesce(F.bool_or("header"), F.lit(False)).alias("head"), F.count("*").alias("width"))
    rows = rows.groupBy(*KEY).agg(F.sort_array(F.collect_list(F.struct("row", "line", "head"))).alias("rows"), F.first("width").alias("width"))
    # the first row without a header cell ends the leading run
    stop = F.array_position(F.transform("rows", lambda x: x["head"]), F.lit(False))
    leading = F.when(stop == 0, F.size("rows")).otherwise(stop - 1).cast("int")
    rows = rows.withColumn("at", F.greatest(leading, F.lit(1)))
    shown = F.transform(F.concat(F.array(F.element_at("rows", F.col("at"))), F.slice("rows", 1, F.col("at") - 1), F.slice("rows", F.col("at") + 1, F.size("rows"))), lambda x: F.concat(F.lit("| "), x["line"], F.lit(" |")))
    rule = F.concat(F.lit("|"), F.repeat(F.lit("---|"), F.col("width").cast("int")))
    return rows.select(*KEY, F.array_join(F.concat(F.slice(shown, 1, 1), F.array(rule), F.slice(shown, 2, F.size(shown))), "\n").alias("gfm"))


def markdown_cell(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("|"), F.lit("\\|")), F.lit("\n"), F.lit(" "))


def needs_rebuild(cells: DataFrame) -> DataFrame:
    """(KEY, rebuild) where a cell's own text is garbage or its repaired text has a script tag."""
    tagged = F.col("repaired").contains("<sub>") | F.col("repaired").contains("<sup>")
    return cells.groupBy(*KEY).agg(F.bool_or((F.col("bbox").isNotNull() & t.is_garbage(F.col("text"))) | tagged).alias("rebuild"))


def rendered(has_spanning_cells: Column, html: Column, gfm: Column) -> Column:
    """HTML for a table with spans, if there is any; else the grid without its caption."""
    return F.when(has_spanning_cells & html.isNotNull(), html).otherwise(h.strip_caption(gfm))


def markup(num_rows: int, num_cols: int, cells: list[tuple]) -> tuple[str, str]:
    """html and gfm of a table of cells (CELL), one at a place at most; texts go into gfm as markdown_cell has them."""
    tags, texts, heads = ({} for _ in range(3))
    for r, c, down, right, header, text in cells:
        if down > 1 or right > 1:
            tags.update({(y, x): "" for y in range(r, r + down) for x in range(c, c + right) if (y, x) != (r, c)})
    for r, c, down, right, header, text in cells:
        tag = "th" if header else "td"
        over = (f' rowspan="{down}"' if down > 1 else "") + (f' colspan="{right}"' if right > 1 else "")
        tags.setdefault((r, c), "" if text is None else f"<{tag}{over}>{text}</{tag}>")
        texts[r, c] = (text or "").replace("|", "\\|").replace("\n", " ")
        heads[r] = heads.get(r, False) or bool(header)
    rows, columns = range(num_rows), range(num_cols)
    html = "".join(f"<tr>{''.join(tags.get((r, c), '<td></td>') for c in columns)}</tr>" for r in rows)
    lines = [f"| {' | '.join(texts.get((r, c), '') for c in columns)} |" for r in rows]
    at = max(next((r for r in rows if not heads.get(r, False)), num_rows) - 1, 0)
    return f"<table><tbody>{html}</tbody></table>", "\n".join([lines[at], "|" + "---|" * num_cols, *lines[:at], *lines[at + 1 :]])


def markup_of_tables(tables: DataFrame) -> DataFrame:
    """(KEY, spans, html, gfm) of tables (KEY, num_rows, num_cols, cells) that come whole, cells being an array of CELL: nothing is shuffled.

    The markup is that of html(grid) and gfm(grid); tables without rows or columns have none. spans: whether a cell spans several places.
    """
    made = [T.StructField("spans", T.BooleanType()), T.StructField("html", T.StringType()), T.StructField("gfm", T.StringType())]
    schema = T.StructType([tables.schema[k] for k in KEY] + made)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        kind = to_arrow_schema(schema)
        for whole in batches:
            for start in range(0, whole.num_rows, TABLES):
                batch = whole.slice(start, TABLES)
                of = batch.column("cells").offsets.to_pylist()
                held = batch.column("cells").values.slice(of[0], of[-1] - of[0])
                cells = list(zip(*[held.field(n).to_pylist() for n in CELL], strict=True))
                own = [cells[a - of[0] : b - of[0]] for a, b in zip(of, of[1:], strict=False)]
                done = [markup(*x) for x in zip(batch.column("num_rows").to_pylist(), batch.column("num_cols").to_pylist(), own, strict=True)]
                columns = [*[batch.column(k) for k in KEY], [any(c[2] > 1 or c[3] > 1 for c in x) for x in own], [x[0] for x in done], [x[1] for x in done]]
                yield pa.RecordBatch.from_arrays([c.cast(f.type) if isinstance(c, pa.Array) else pa.array(c, f.type) for c, f in zip(columns, kind, strict=True)], schema=kind)

    return tables.where("num_rows > 0 and num_cols > 0 and cells is not null").select(*KEY, "num_rows", "num_cols", F.transform("cells", lambda c: F.struct(*[c[n].alias(n) for n in CELL])).alias("cells")).mapInArrow(run, schema)
