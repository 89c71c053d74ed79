"""Deeply nested JSON records as related flat tables, by the shape of every object.

A bottom-up tree automaton gives each JSON value a state: scalars by kind, an office object by its
fields, a list by how it is stored and what it holds, a node by its lists, a document by where its
nodes are. Each state of an object has a typed subtype table of its own (NODE_TABLES, OFFICE_TABLES), and
objects are routed to it by their state; all rows keep the supertype keys (record_id, node_no, list_name,
item_no), which are also the parent links. Payloads are read row by row and never shuffled: records that repeat
exactly give equal rows, which are dropped from the flat tables.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

OFFICE_LISTS = ("scienceOffices", "highOffices")
#: Fields by which an object is known as an office itself, rather than as a map that holds offices.
OFFICE_MARKS = ("id", "zh", "pinyin", "en", "sequence")
NODE_MARKS = ("id", "nameZh", "nameEn", "nodeType", *OFFICE_LISTS)
_OFFICE = {"zh": "string", "pinyin": "string", "en": "string", "sequence": "int", "firstYear": "int", "lastYear": "int"}
_BUREAU = {"bureauType": "string", "bureauZh": "string", "bureauEn": "string"}
#: For each state of an office object, the fields of its table beside the keys.
OFFICE_TABLES = {
    "office_bureau": {"id": "long", **_OFFICE, **_BUREAU},
    "office_bureau_textual": {"id": "long", **_OFFICE, **_BUREAU},
    "office_plain": {"id": "long", **_OFFICE},
    "office_plain_textual": {"id": "long", **_OFFICE},
    "office_unkeyed": {**_OFFICE, **_BUREAU},
}
_NODE = {"id": "long", "nameZh": "string", "nameEn": "string", "indexYear": "int", "dynastyCode": "int", "nodeType": "string", "isMain": "boolean"}
#: For each state of a node object, the fields of its table beside the keys.
NODE_TABLES = {state: _NODE for state in ("node_of_both", "node_of_science", "node_of_high", "node_without_office")}


def _is_object(v: Column) -> Column:
    """Whether a JSON value is an object, told by one field rather than by its whole schema."""
    return F.try_variant_get(v, "$", "struct<id:variant>").isNotNull()


def _leaf(v: Column) -> Column:
    """State of one JSON value by its own kind: absent, null, object, array, text or scalar."""
    return (
        F.when(v.isNull(), "absent")
        .when(F.is_variant_null(v), "null")
        .when(_array(v).isNotNull(), "array")
        .when(_is_object(v), "object")
        .when(F.schema_of_variant(v) == "STRING", "text")
        .otherwise("scalar")
    )


def _has_any(v: Column, fields) -> Column:
    """Whether an object has one of the fields, be it a JSON null."""
    return F.coalesce(*(F.try_variant_get(v, f"$.{f}", "variant") for f in fields)).isNotNull()


def _array(v: Column) -> Column:
    return F.try_variant_get(v, "$", "array<variant>")


def _inner(v: Column) -> Column:
    """The JSON value that a text holds."""
    return F.try_parse_json(F.try_variant_get(v, "$", "string"))


def _entries(v: Column, marks) -> Column:
    """The entries of a list that is an array, one object, or an object whose values are the entries; else null.
    Arrays, the usual form, are read once."""
    single = F.when(_is_object(v) & _has_any(v, marks), F.array(v))
    keyed = F.when(_is_object(v), F.map_values(F.try_variant_get(v, "$", "map<string,variant>")))
    return F.coalesce(_array(v), single, keyed)


def _stored_items(v: Column, marks) -> Column:
    """The entries of a list that may be stored as JSON text as well (read once, not again inside itself)."""
    held = F.when(F.schema_of_variant(v) == "STRING", _entries(_inner(v), marks))
    return F.coalesce(_entries(v, marks), held, F.array().cast("array<variant>"))


def _form(v: Column, marks) -> Column:
    """How a list is stored: array, single, keyed, another leaf state, or text_ and one of these."""

    def plain(w: Column) -> Column:
        leaf = _leaf(w)
        return F.when(leaf == "object", F.when(_has_any(w, marks), "single").otherwise("keyed")).otherwise(leaf)

    return F.when(_leaf(v) == "text", F.concat(F.lit("text_"), plain(_inner(v)))).otherwise(plain(v))


def _objects(items: Column) -> Column:
    return F.filter(items, _is_object)


def _office_state(v: Column) -> Column:
    """office_bureau or office_plain by the bureau fields, with _textual where the id is stored as
    text, or office_unkeyed without a usable id."""
    bureau = F.when(_has_any(v, ("bureauType", "bureauZh", "bureauEn")), "office_bureau").otherwise("office_plain")
    number = F.try_variant_get(v, "$.id", "long")
    raw = F.schema_of_variant(F.try_variant_get(v, "$.id", "variant"))
    return F.when(number.isNull(), "office_unkeyed").when(raw == "STRING", F.concat(bureau, F.lit("_textual"))).otherwise(bureau)


def _list_state(form: Column, states: Column) -> Column:
    """A list's state: its form, and empty / one_kind / mixed by the distinct states of its objects."""
    kinds = F.size(F.array_distinct(states))
    return F.concat(form, F.when(F.size(states) == 0, "_empty").when(kinds == 1, "_of_one_kind").otherwise("_mixed"))


def documents(records: DataFrame, id_col: str = "record_id", payload_col: str = "payload", once: bool = True) -> DataFrame:
    """(record_id, document_state, root variant) for each record, or, with `once`, for each one that isn't an exact
    repeat (which shuffles the payloads).

    States: document_flat, document_wrapped (under `data`), document_bare (JSON without nodes),
    document_broken (not whole JSON) and document_missing (null payload).
    """
    rows = records.select(F.col(id_col).alias("record_id"), F.col(payload_col).alias("payload"))
    rows = rows.distinct() if once else rows
    whole = F.try_parse_json("payload")
    read = rows.withColumn("whole", whole)
    data = F.try_variant_get("whole", "$.data", "variant")
    flat = F.try_variant_get("whole", "$.nodes", "variant").isNotNull()
    wrapped = ~flat & (F.try_variant_get(data, "$.nodes", "variant").isNotNull())
    state = (
        F.when(F.col("payload").isNull(), "document_missing")
        .when(F.col("whole").isNull(), "document_broken")
        .when(flat, "document_flat")
        .when(wrapped, "document_wrapped")
        .otherwise("document_bare")
    )
    return read.select("record_id", state.alias("document_state"), F.when(wrapped, data).otherwise(F.col("whole")).alias("root"))


def shapes(records: DataFrame, id_col: str = "record_id", payload_col: str = "payload") -> DataFrame:
    """One row for each node object, with its state and its office lists classified bottom-up:
    record_id, document_state, node_no, node_state, node, and for each list a struct
    (name, state, items of (item_no, state, office)).

    Nulls and values that aren't objects are no nodes and no offices and aren't counted in node_no and
    item_no. Records without node objects give no rows. A record that repeats exactly gives its rows again; the
    flat tables hold them once.
    """
    root = documents(records, id_col, payload_col, once=False).withColumn("nodes", F.try_variant_get("root", "$.nodes", "variant"))
    items = _objects(_stored_items(F.col("nodes"), NODE_MARKS))
    node = root.select("record_id", "document_state", F.posexplode(items).alias("at", "node")).withColumn("node_no", F.col("at") + 1)
    node = node.withColumns({f"_{name}": F.try_variant_get("node", f"$.{name}", "variant") for name in OFFICE_LISTS})
    offices = lambda name: F.transform(
        _objects(_stored_items(F.col(f"_{name}"), OFFICE_MARKS)),
        lambda o, i: F.struct((i + 1).cast("int").alias("item_no"), _office_state(o).alias("state"), o.alias("office")),
    )
    node = node.withColumns({name: offices(name) for name in OFFICE_LISTS})
    return node.select(
        "record_id",
        "document_state",
        "node_no",
        _node_state(*(F.size(n) for n in OFFICE_LISTS)).alias("node_state"),
        "node",
        *OFFICE_LISTS,
        *(_list_state(_form(F.col(f"_{n}"), OFFICE_MARKS), F.transform(n, lambda o: o["state"])).alias(f"{n}_state") for n in OFFICE_LISTS),
    )


def _node_state(science: Column, high: Column) -> Column:
    """A node's state by the number of offices in its lists."""
    both = (science > 0) & (high > 0)
    return F.when(both, "node_of_both").when(science > 0, "node_of_science").when(high > 0, "node_of_high").otherwise("node_without_office")


def _snake(name: str) -> str:
    return "".join(f"_{c.lower()}" if c.isupper() else c for c in name)


def _typed(of: str, fields: dict[str, str], prefix: str) -> list[Column]:
    """The fields of an object as columns. Values that don't have their type are null."""
    return [F.try_variant_get(of, f"$.{name}", kind).alias(f"{prefix}_id" if name == "id" else _snake(name)) for name, kind in fields.items()]


def _node_rows(shaped: DataFrame, states: Sequence[str], fields: dict[str, str]) -> DataFrame:
    rows = shaped.where(F.col("node_state").isin(*states))
    return rows.select("record_id", "node_no", "document_state", "node_state", *(f"{n}_state" for n in OFFICE_LISTS), *_typed("node", fields, "node")).distinct()


def _with_name(name: str) -> Column:
    """A list's offices with the list's name."""
    return F.transform(name, lambda o: F.struct(F.lit(name).alias("list_name"), o["item_no"].alias("item_no"), o["state"].alias("office_state"), o["office"].alias("office")))


def _office_rows(shaped: DataFrame, states: Sequence[str], fields: dict[str, str]) -> DataFrame:
    listed = F.concat(*(_with_name(name) for name in OFFICE_LISTS))
    rows = shaped.select("record_id", "node_no", F.inline(F.filter(listed, lambda o: o["office_state"].isin(*states))))
    return rows.select("record_id", "node_no", "list_name", "item_no", "office_state", *_typed("office", fields, "office")).distinct()


def node_table(shaped: DataFrame, states: Sequence[str] = tuple(NODE_TABLES)) -> DataFrame:
    """The node supertype: keys, states and typed fields of the nodes of the given states."""
    return _node_rows(shaped, states, _NODE)


def office_table(shaped: DataFrame, states: Sequence[str] = tuple(OFFICE_TABLES)) -> DataFrame:
    """The office supertype: keys of the office and of its node, state, and the fields that the given states share
    or have alone (null where an office lacks them)."""
    fields = {name: kind for state in states for name, kind in OFFICE_TABLES[state].items()}
    return _office_rows(shaped, states, fields)


def subtype_tables(shaped: DataFrame) -> dict[str, DataFrame]:
    """One typed table for each state of NODE_TABLES and OFFICE_TABLES, by name. Every object is a row of
    the one table of its state, with the keys it has in the supertype."""
    nodes = {state: _node_rows(shaped, [state], fields) for state, fields in NODE_TABLES.items()}
    return nodes | {state: _office_rows(shaped, [state], fields) for state, fields in OFFICE_TABLES.items()}


def object_keys(shaped: DataFrame) -> DataFrame:
    """(record_id, node_no, list_name, item_no) of every routed object: every node (list `nodes`, item 0) and every
    office, the keys of all `subtype_tables` together, in one pass over the records.

    Every state has a table, so the items of a list are numbered without a hole, and a node's keys travel as one row
    with the number of routed objects of each list; records that repeat meet there.
    """
    counted = [F.max(F.size(F.filter(name, lambda o: o["state"].isin(*OFFICE_TABLES)))).alias(name) for name in OFFICE_LISTS]
    node = shaped.groupBy("record_id", "node_no").agg(*counted).where(_node_state(*map(F.col, OFFICE_LISTS)).isin(*NODE_TABLES))
    key = lambda name, item: F.struct(F.lit(name).alias("list_name"), item.cast("int").alias("item_no"))
    none = F.array().cast("array<struct<list_name:string,item_no:int>>")

    def listed(name: str) -> Column:
        return F.when(F.col(name) > 0, F.transform(F.sequence(F.lit(1), F.greatest(F.col(name), F.lit(1))), lambda i: key(name, i))).otherwise(none)

    return node.select("record_id", "node_no", F.inline(F.concat(F.array(key("nodes", F.lit(0))), *map(listed, OFFICE_LISTS))))
