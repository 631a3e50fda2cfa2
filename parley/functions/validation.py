"""JSON objects against a tree of fields: every path that fails, or the object repaired and what was put where.

The object is parsed once into a VARIANT (once for each of the repairing form's parts that are used) and taken apart
once into its members (the repairing form's value looks at paths); each field of the tree looks up its own, so all
failing paths are found, not the first, and a field that is not there costs a look-up in what is. The rejecting form takes missing fields as their defaults and numbers out of
range as their bounds; the repairing form also puts defaults for what does not fit.

Cases: null and blank texts are an empty object; what is no JSON or no object fails as a whole, at the path ``$``, and is
repaired to the defaults; keys that the tree does not know are kept apart; of repeated keys JSON parsing
decides (an error, so the whole fails).
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from parley.functions.display import is_shortcut, names_in
from parley.functions.text import clean

NOT_JSON, NOT_OBJECT, WRONG_TYPE, NOT_ONE_OF, NOT_USABLE = "not JSON", "not an object", "wrong type", "not one of the choices", "not usable"
PROBLEM = "array<struct<path:string,problem:string,found:string>>"
CHANGE = "struct<path:string,found:string,put:string>"
REPAIR = f"array<{CHANGE}>"


@dataclass(frozen=True)
class Field:
    """A value of a kind: text (not blank), any_text, optional (text or null), flag, number, choice, names or shortcut."""

    kind: str
    default: object = None
    choices: tuple[str, ...] = ()
    low: float = 0
    high: float = 0
    whole: bool = False


Tree = dict[str, "Field | Tree"]

#: An application's settings, their defaults and bounds.
SETTINGS: Tree = {
    "sttModel": Field("text", "gigaam-multilingual-ctc"),
    "numThreads": Field("number", 4, low=1, high=32, whole=True),
    "captureMic": Field("flag", True),
    "captureSystem": Field("flag", True),
    "micMode": Field("choice", "me", ("me", "room")),
    "micDevice": Field("optional"),
    "systemDevice": Field("optional"),
    "echoCancellation": Field("flag", True),
    "sttBackend": Field("choice", "auto", ("auto", "ort", "sherpa")),
    "hintEffort": Field("choice", "low", ("low", "medium", "high")),
    "summaryEffort": Field("choice", "high", ("low", "medium", "high", "xhigh")),
    "myNames": Field("names"),
    "rollingSummaryMinutes": Field("number", 4, low=0, high=120),
    "answerLanguage": Field("choice", "auto", ("auto", "ru", "kk")),
    "profile": Field("any_text", ""),
    "hotkeys": {"hint": Field("shortcut", "CommandOrControl+Alt+Enter"), "recap": Field("shortcut", "CommandOrControl+Alt+KeyK"), "toggle": Field("shortcut", "CommandOrControl+Alt+KeyP")},
}
TYPES = {"text": "STRING", "any_text": "STRING", "optional": "STRING", "flag": "BOOLEAN", "choice": "STRING", "shortcut": "STRING"}


def parsed(json: Column) -> Column:
    """The text as VARIANT; an empty object for none, null for what is no JSON."""
    return F.try_parse_json(F.coalesce(F.nullif(F.trim(json), F.lit("")), F.lit("{}")))


def _bound(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once however often the body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _members(value: Column) -> Column:
    """An object's values by name; null for what is no object."""
    return F.try_variant_get(value, "$", "map<string,variant>")


def _kind(value: Column) -> Column:
    """The type of a value, without its parts; null if it is missing."""
    return F.substring_index(F.substring_index(F.schema_of_variant(value), "<", 1), "(", 1)


def _each(members: Column, tree: Tree, one: Callable[[str, Field, Column], Column], kind: str, path: str = "$") -> Column:
    """Array (of type ``kind``) of what ``one`` makes of each value that is there, in the tree's order, an object before its fields; without nulls."""

    def given(name: str, body: Callable[[Column], Column]) -> Column:
        value = F.element_at(members, F.lit(name))
        return F.when(value.isNotNull(), _bound(value, body))

    def nested(own: str, node: Tree) -> Callable[[Column], Column]:
        return lambda v: F.concat(F.array(one(own, Field("object"), v)), _bound(_members(v), lambda inner: _each(inner, node, one, kind, own)))

    def leaf(own: str, node: Field) -> Callable[[Column], Column]:
        return lambda v: one(own, node, v)

    parts, leaves = [], []
    for name, node in tree.items():
        if isinstance(node, Field):
            leaves.append(given(name, leaf(f"{path}.{name}", node)))
        else:
            parts += [F.array(*leaves)] * bool(leaves) + [F.coalesce(given(name, nested(f"{path}.{name}", node)), F.array().cast(kind))]
            leaves = []
    return F.filter(F.concat(*parts, *[F.array(*leaves)] * bool(leaves)), lambda x: x.isNotNull())


def _text(value: Column) -> Column:
    return F.try_variant_get(value, "$", "string")


def _problem(value: Column, field: Field) -> Column:
    """What is wrong with a value that is there; null if nothing is."""
    kind, text = _kind(value), _text(value)
    if field.kind == "object":
        wrong = F.when(_members(value).isNull(), WRONG_TYPE)
    elif field.kind == "number":
        wrong = F.when(~kind.isin("BIGINT", "DOUBLE", "DECIMAL", "FLOAT"), WRONG_TYPE)
    elif field.kind == "names":
        wrong = F.when(~kind.isin("ARRAY", "STRING"), WRONG_TYPE)
    elif field.kind == "optional":
        wrong = F.when(~kind.isin(TYPES[field.kind], "VOID"), WRONG_TYPE)
    else:
        wrong = F.when(kind != TYPES[field.kind], WRONG_TYPE)
        if field.kind == "choice":
            wrong = F.coalesce(wrong, F.when(~text.isin(*field.choices), NOT_ONE_OF))
        elif field.kind == "shortcut":
            wrong = F.coalesce(wrong, F.when(~is_shortcut(text), NOT_USABLE))
        elif field.kind == "text":
            wrong = F.coalesce(wrong, F.when(clean(text) == "", NOT_USABLE))
    return F.when(value.isNotNull(), wrong)


def problems(json: Column, tree: Tree = SETTINGS) -> Column:
    """Array of (path, problem, found): every value that does not fit, in the tree's order; empty if the object is fine."""
    one = lambda path, problem, found: F.struct(path.alias("path"), problem.alias("problem"), found.alias("found"))

    def check(path: str, field: Field, value: Column) -> Column:
        return _bound(_problem(value, field), lambda p: F.when(p.isNotNull(), one(F.lit(path), p, F.to_json(value))))

    def listed(root: Column) -> Column:
        whole = lambda problem: F.array(one(F.lit("$"), F.lit(problem), json)).cast(PROBLEM)
        return _bound(_members(root), lambda members: F.when(members.isNotNull(), _each(members, tree, check, PROBLEM).cast(PROBLEM)).when(root.isNull(), whole(NOT_JSON)).otherwise(whole(NOT_OBJECT)))

    return _bound(parsed(json), listed)


def _repaired(value: Column, field: Field) -> Column:
    """The value to use: the given one where it fits, within its bounds, else the default."""
    fine = value.isNotNull() & _problem(value, field).isNull()
    default = F.lit(field.default)
    if field.kind == "number":
        bounded = F.greatest(F.least(F.try_variant_get(value, "$", "double"), F.lit(float(field.high))), F.lit(float(field.low)))
        used = F.when(fine, bounded).otherwise(F.lit(float(field.default)))
        return F.floor(used + 0.5).cast("long") if field.whole else used
    if field.kind == "flag":
        return F.when(fine, F.try_variant_get(value, "$", "boolean")).otherwise(default)
    if field.kind == "names":
        given = F.when(_kind(value) == "STRING", _text(value)).otherwise(F.array_join(F.filter(F.try_variant_get(value, "$", "array<string>"), lambda x: x.isNotNull()), "\n"))
        return F.coalesce(names_in(F.when(fine, given)), F.array().cast("array<string>"))
    if field.kind == "optional":
        return F.nullif(F.when(fine, _text(value)), F.lit(""))
    return F.when(fine, _text(value)).otherwise(default)


def _struct(root: Column, tree: Tree, path: str = "$") -> Column:
    """The tree's fields from their paths, of which a root that is no object has none."""
    one = lambda field, own: _bound(F.try_variant_get(root, own, "variant"), lambda v: _repaired(v, field))
    return F.struct(*[(one(x, f"{path}.{n}") if isinstance(x, Field) else _struct(root, x, f"{path}.{n}")).alias(n) for n, x in tree.items()])


def repaired(json: Column, tree: Tree = SETTINGS) -> Column:
    """Struct value (as the tree), rest (unknown keys with their JSON) and repairs (path, found, put) of values that were there and changed.

    A caller that wants some fields only passes a tree of these; the others then count as unknown keys.
    """
    with_members = lambda body: _bound(_members(parsed(json)), body)
    known = list(tree)

    def rest(members: Column) -> Column:
        listed = F.coalesce(members, F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<variant>")))
        return F.transform_values(F.map_filter(listed, lambda k, _: ~k.isin(*known)), lambda _, v: F.to_json(v))

    def change(path: str, field: Field, value: Column) -> Column:
        def of(used: Column) -> Column:
            put = F.substring(F.to_json(F.struct(used.alias("v")), {"ignoreNullFields": "false"}), 6, 1 << 30)
            put = F.substr(put, F.lit(1), F.length(put) - 1)  # without {"v": and }
            differ = F.when(~_same(value, used, field), put)
            return _bound(differ, lambda d: F.when(d.isNotNull(), F.struct(F.lit(path).alias("path"), F.to_json(value).alias("found"), d.alias("put"))))

        return F.lit(None).cast(CHANGE) if field.kind == "object" else _bound(_repaired(value, field), of)

    def repairs(members: Column) -> Column:
        return F.when(members.isNotNull(), _each(members, tree, change, REPAIR).cast(REPAIR)).otherwise(F.array().cast(REPAIR))

    return F.struct(_bound(parsed(json), lambda root: _struct(root, tree)).alias("value"), with_members(rest).alias("rest"), with_members(repairs).alias("repairs"))


def _same(given: Column, used: Column, field: Field) -> Column:
    """Whether the value to use is the given one."""
    fine = _problem(given, field).isNull()
    if field.kind == "number":
        return F.coalesce(F.try_variant_get(given, "$", "double") == used.cast("double"), F.lit(False)) & fine
    if field.kind == "names":
        return F.coalesce((_kind(given) == "ARRAY") & (F.try_variant_get(given, "$", "array<string>") == used), F.lit(False))
    if field.kind == "optional":
        return F.when(_kind(given) == "VOID", True).otherwise(F.coalesce(_text(given) == used, F.lit(False))) & fine
    return fine
