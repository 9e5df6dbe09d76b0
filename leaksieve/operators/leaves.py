"""JSON down to its leaves: every value with the keys that lead to it.

A text is parsed once and unfolded level by level inside one expression, as many levels
as its brackets are deep, so that any depth is one projection on the row: no shuffle,
no intermediate table, the same in batch and in streaming.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.matching import let

_NODES = "array<struct<path:string,keys:string,node:variant>>"


def _depth(text: Column) -> Column:
    """How deep the brackets of a JSON text go; those within strings don't count."""
    unescaped = F.regexp_replace(text, r"(?s)\\.", "")
    brackets = F.regexp_extract_all(F.regexp_replace(unescaped, '"[^"]*"', ""), F.lit(r"[\[{\]}]"), F.lit(0))
    zero = F.struct(F.lit(0).alias("now"), F.lit(0).alias("most"))

    def step(acc: Column, bracket: Column) -> Column:
        now = acc["now"] + F.when(bracket.isin("[", "{"), F.lit(1)).otherwise(F.lit(-1))
        return F.struct(now.alias("now"), F.greatest(acc["most"], now).alias("most"))

    return F.aggregate(brackets, zero, step, lambda acc: acc["most"])


def _pointer(key: Column) -> Column:
    return F.replace(F.replace(key, F.lit("~"), F.lit("~0")), F.lit("/"), F.lit("~1"))


def _children(parent: Column) -> Column:
    """The nodes one level below; a leaf stays what it is."""
    def child(path: Column, keys: Column, node: Column) -> Column:
        return F.struct(path.alias("path"), keys.alias("keys"), node.alias("node"))

    def of_object(members: Column) -> Column:
        return F.transform(F.map_entries(members), lambda member: child(
            F.concat(parent["path"], F.lit("/"), _pointer(member["key"])),
            F.when(parent["keys"] == "", member["key"]).otherwise(F.concat(parent["keys"], F.lit("."), member["key"])),
            member["value"]))

    def of_list(items: Column) -> Column:
        return F.transform(items, lambda item, i: child(F.concat(parent["path"], F.lit("/"), i.cast("string")), parent["keys"], item))

    return F.coalesce(
        of_object(F.try_variant_get(parent["node"], "$", "map<string,variant>")),
        of_list(F.try_variant_get(parent["node"], "$", "array<variant>")),
        F.array(parent))


def _unfolded(text: Column) -> Column:
    """Leaves as an array of (path, keys, value); null if the text is no JSON."""
    def below(root: Column) -> Column:
        nodes = F.array(F.struct(F.lit("").alias("path"), F.lit("").alias("keys"), root.alias("node"))).cast(_NODES)
        none = F.array().cast("array<int>")
        levels = let(_depth(text), lambda depth: F.when(depth > 0, F.sequence(F.lit(1), depth)).otherwise(none))
        return F.aggregate(levels, nodes, lambda acc, _: F.flatten(F.transform(acc, _children)))

    def valued(leaf: Column) -> Column:
        value = F.try_variant_get(leaf["node"], "$", "string")
        return F.struct(leaf["path"].alias("path"), leaf["keys"].alias("keys"), value.alias("value"))

    root = F.try_parse_json(text)
    leaves = let(root, lambda parsed: F.when(parsed.isNotNull(), F.transform(below(parsed), valued)))
    return F.filter(leaves, lambda leaf: leaf["value"].isNotNull())


def json_leaves(units: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """Units of JSON as one unit per string, number or boolean in them.

    The text of a leaf is ``a.b = "value"``, escapes undone: the keys that lead to the value are the left context that rules
    on names of credentials ask for. ``path`` is the JSON pointer of the leaf and ``value_at`` the place in
    the text where the value begins, so that ``start - value_at`` is the place within the value. Places in
    lists are in the path only. ``unit_id`` is the JSON's with ``#`` and the path behind it.

    Null members and empty containers have no text and give no row. A text that isn't JSON, or that names a
    member twice, is handed on as it is, with a null path, so that nothing goes unscanned; a null or empty text gives no row.
    Members come in the order of their names. The first leaf of a unit that is ``named`` is named, too; a ``named`` unit without leaves has nobody to speak for its name.
    """
    named = F.col("named") if "named" in units.columns else F.lit(True)
    context = F.col("context") if "context" in units.columns else F.lit("raw")
    whole = F.array(F.struct(F.lit(None).cast("string").alias("path"), F.lit("").alias("keys"), F.col("text").alias("value")))
    found = F.when(F.col("text") != "", F.coalesce(_unfolded(F.col("text")), whole))
    leaf = F.col("__leaf")
    before = F.when(leaf["keys"] == "", F.lit("")).otherwise(F.concat(leaf["keys"], F.lit(' = "')))
    after = F.when(leaf["keys"] == "", F.lit("")).otherwise(F.lit('"'))
    return units.select(
        F.col("unit_id").alias("__unit"), "uri", context.alias("context"), named.alias("__named"), *keep, F.posexplode(found).alias("__i", "__leaf"),
    ).select(
        F.when(leaf["path"].isNull(), F.col("__unit")).otherwise(F.concat("__unit", F.lit("#"), leaf["path"])).alias("unit_id"),
        "uri", "context", F.concat(before, leaf["value"], after).alias("text"), (F.col("__named") & (F.col("__i") == 0)).alias("named"),
        leaf["path"].alias("path"), F.length(before).alias("value_at"), *keep)
