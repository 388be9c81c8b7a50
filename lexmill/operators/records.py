"""Small keyed tables: settings, registry, overrides, history, outlines, forms, links.

Each is a join or an aggregate by its key; rows of one key are few.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.filing_text import csv_escaped, html_escaped
from ..functions.storage import stored

# Fixed values.
REGISTERED = "titledoc:"
HISTORY = ("Opened", "Source name", "Footer name", "Footer", "Final name")
HISTORY_FIELDS = ("timestamp", "source_title", "footer_name", "footer_title", "final_name")
LINK, LEAST_LINK, LEAST_FIELD = 2, 1, 2


def settings(stored: DataFrame, wanted: DataFrame) -> DataFrame:
    """key, value: of `wanted` (key, default), what is stored, or else the default."""
    return wanted.join(stored.select("key", "value"), "key", "left").select("key", F.coalesce("value", "default").alias("value"))


def swept(entries: DataFrame, tabs: DataFrame) -> DataFrame:
    """Entries whose tab is open, and those of other kinds. A key is `titledoc:` and a number."""
    number = F.expr(f"try_cast(substring(key, {len(REGISTERED) + 1}) AS bigint)")
    ours = F.startswith("key", F.lit(REGISTERED))
    rows = entries.withColumn("__tab", F.when(ours, number))
    kept = rows.where(~F.startswith("key", F.lit(REGISTERED)))
    live = rows.where(ours).join(tabs.select(F.col("tab_id").alias("__tab")).distinct(), "__tab", "left_semi")
    return kept.unionByName(live).drop("__tab")


def with_overrides(documents: DataFrame, overrides: DataFrame) -> DataFrame:
    """`documents` with naming_mode of their URL's latest override (url, ts, mode), or null."""
    latest = overrides.groupBy("url").agg(F.max_by("mode", "ts").alias("naming_mode"))
    return documents.join(latest, "url", "left")


def with_final_names(history: DataFrame, names: DataFrame) -> DataFrame:
    """`history` with the final names that `names` (id, name) revises, and `changed`."""
    rows = history.join(names.select("id", "name"), "id", "left")
    changes = F.col("name").isNotNull() & ~F.col("name").eqNullSafe(F.col("final_name"))
    return rows.withColumn("changed", changes).withColumn("final_name", F.coalesce("name", "final_name")).drop("name")


def newest_first(history: DataFrame) -> Column:
    return F.row_number().over(Window.orderBy(F.col("timestamp").desc(), "id"))


def history_csv(history: DataFrame) -> DataFrame:
    """position, line: a header, then a row each; to be written with `\\r\\n` between them.
    The header begins with a byte-order mark. `history` is capped by its feature, so that one
    task orders it."""
    fields = [csv_escaped(F.coalesce(F.col(c).cast("string"), F.lit(""))) for c in HISTORY_FIELDS]
    rows = history.select(newest_first(history).cast("long").alias("position"), F.concat_ws(",", *fields).alias("line"))
    head = history.sparkSession.createDataFrame([(0, "﻿" + ",".join(HISTORY))], "position long, line string")
    return head.unionByName(rows)


def history_html(history: DataFrame) -> DataFrame:
    """position, line: table rows; a missing value is a dash, the time loses its `T` and fraction."""
    at = F.regexp_replace(F.regexp_replace(csv_escaped(F.coalesce(F.col("timestamp").cast("string"), F.lit(""))), "^([^T]*)T", "$1 "), r"\.\d+Z$", "")
    dash = F.lit("<em style='color:#aaa'>—</em>")
    cells = [at, *[F.when(F.coalesce(F.col(c), F.lit("")) == "", dash).otherwise(html_escaped(F.col(c))) for c in HISTORY_FIELDS[1:]]]
    line = F.concat(F.lit("<tr>"), *[F.concat(F.lit("<td>"), c, F.lit("</td>")) for c in cells], F.lit("</tr>"))
    return history.select(newest_first(history).cast("long").alias("position"), line.alias("line"))


def changed_lists(lists: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """`lists` (provider, authorities: array of (kind, key), and more) whose signature is not
    that of the one before under `keys`."""
    said = F.array_join(F.transform("authorities", lambda a: F.concat(a["kind"], F.lit(":"), a["key"])), "||")
    rows = lists.withColumn("signature", F.concat(F.col("provider"), F.lit("|"), said))
    before = F.lag("signature").over(Window.partitionBy(*keys).orderBy(*order))
    return rows.withColumn("__before", before).where(~F.col("signature").eqNullSafe(F.col("__before"))).drop("__before")


def outline(nodes: DataFrame) -> DataFrame:
    """doc_id, id, depth, position, title: a table of nodes (doc_id, id, parent_id, ordinal,
    title) depth first. Each level is a join with the one above it, written before the next;
    a node whose parents don't reach a root has no place. Nodes are numbered inside ranges of
    (doc_id, path), so that a document may be as large as the table."""
    step = F.struct(F.col("ordinal").cast("bigint").alias("ordinal"), "id")
    rows = stored(nodes.select("doc_id", "id", "parent_id", "title", step.alias("step")), "outline-nodes")
    level = stored(rows.where("parent_id IS NULL").select("doc_id", "id", "title", F.array("step").alias("path")), "outline-level")
    walked = level
    while not level.isEmpty():
        above = level.select("doc_id", F.col("id").alias("parent_id"), "path")
        level = rows.join(above, ["doc_id", "parent_id"]).select("doc_id", "id", "title", F.array_append("path", F.col("step")).alias("path"))
        level = stored(level, "outline-level")
        walked = walked.unionByName(level)
    ranges = stored(walked.repartitionByRange("doc_id", "path").withColumn("range", F.spark_partition_id()), "outline-ranges")
    sizes = ranges.groupBy("doc_id", "range").agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy("doc_id").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    before = sizes.select(F.col("doc_id").alias("__doc"), F.col("range").alias("__range"), F.coalesce(F.sum("n").over(w), F.lit(0)).alias("before"))
    inside = F.row_number().over(Window.partitionBy("doc_id", "range").orderBy("path"))
    rows = ranges.withColumn("inside", inside).join(before, F.col("doc_id").eqNullSafe(F.col("__doc")) & (F.col("range") == F.col("__range")))
    title = F.when(F.coalesce("title", F.lit("")) == "", "(untitled)").otherwise(F.col("title"))
    return rows.select("doc_id", "id", F.size("path").cast("long").alias("depth"), (F.col("before") + F.col("inside")).cast("long").alias("position"), title.alias("title"))


def native_links(annotations: DataFrame) -> DataFrame:
    """Link annotations with somewhere to go and an extent: left, top, width and height of
    the corners x1, y1, x2, y2."""
    goes = (F.coalesce("url", F.lit("")) != "") | F.col("dest").isNotNull()
    rows = annotations.where((F.col("type") == LINK) & goes & F.col("x1").isNotNull())
    rows = rows.select(*annotations.columns, F.least("x1", "x2").alias("left"), F.least("y1", "y2").alias("top"), F.abs(F.col("x2") - F.col("x1")).alias("width"), F.abs(F.col("y2") - F.col("y1")).alias("height"))
    return rows.where((F.col("width") >= LEAST_LINK) & (F.col("height") >= LEAST_LINK))


def form_fields(widgets: DataFrame) -> DataFrame:
    """Widgets that can be filled in: with a name and an extent, and no push buttons; `control` says how."""
    rows = widgets.where(F.col("field_name").isNotNull() & ~F.coalesce("push_button", F.lit(False)) & (F.col("width") >= LEAST_FIELD) & (F.col("height") >= LEAST_FIELD))
    kind = F.col("field_type")
    control = F.when((kind == "Tx") & F.coalesce("multi_line", F.lit(False)), "textarea").when(kind == "Tx", "text")
    control = control.when((kind == "Btn") & F.coalesce("check_box", F.lit(False)), "checkbox").when((kind == "Btn") & F.coalesce("radio_button", F.lit(False)), "radio")
    return rows.withColumn("control", control.when((kind == "Ch") & (F.size("options") > 0), "select")).where("control IS NOT NULL")


def filled(fields: DataFrame, values: DataFrame) -> DataFrame:
    """`fields` (doc_id, name, control, value, options) with what `values` (doc_id, name, new)
    says; a field without one keeps its value, and so does a choice that has no such option.
    A radio button's value may be an option's name or its place."""
    rows = fields.join(values.select("doc_id", "name", "new", F.lit(True).alias("__given")), ["doc_id", "name"], "left")
    new, options = F.col("new"), F.col("options")
    blank = F.coalesce(new, F.lit("")) == ""
    place = F.expr("try_cast(regexp_extract(new, '^\\\\s*([+-]?[0-9]+)', 1) AS int)")
    known = F.array_contains(options, new)
    by_place = F.when(place >= 0, F.get(options, place))
    radio = F.when(blank, F.lit(None)).otherwise(F.coalesce(F.when(known, new), by_place, F.col("value")))
    choice = F.when(blank, F.lit(None)).when(known, new).otherwise(F.col("value"))
    box = F.when(blank | (new == "false"), "false").otherwise("true")
    given = F.when(F.col("control") == "text", F.coalesce(new, F.lit(""))).when(F.col("control") == "checkbox", box).when(F.col("control") == "radio", radio).otherwise(choice)
    return rows.withColumn("value", F.when(F.col("__given"), given).otherwise(F.col("value"))).drop("new", "__given")


def has_case(cites: DataFrame, documents: DataFrame) -> DataFrame:
    """`documents` with has_case: whether any of their citations is of a case."""
    some = cites.where("kind = 'case'").select("doc_id").distinct().withColumn("has_case", F.lit(True))
    return documents.join(some, "doc_id", "left").withColumn("has_case", F.coalesce("has_case", F.lit(False)))
