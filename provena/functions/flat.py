"""Strict JSON texts as their nodes: each value of a document with its pointer, its kind, and the digest of its canonical form.

One pass over a text from the leaves up spells each subtree once (keys in code-point order, numbers and control characters as the canonical
form has them), so digests of all subtrees come with it, and those of objects without the field that seals them. Documents of one form have
their places in common: pointers and patterns are made once and taken by number."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator
from functools import partial
from itertools import compress, repeat
from json.encoder import encode_basestring
from operator import itemgetter

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from provena.functions import canonical

#: pointer and its pattern (RFC 6901; in the pattern * stands for places of arrays and keys of maps), those of the parent, own key, kind, value
#: (canonical text of scalars), n (members), sha256 of the canonical form with its newline, body_sha256 of that of an object without its seal.
NODE = "pointer string, pattern string, parent string, above string, key string, kind string, value string, n bigint, sha256 string, body_sha256 string"
#: Of an object the names of its members and the value of its seal.
MEMBERS = "names array<string>, seal string"
#: Of a document, with its root: the outputs it seals and those it declares, as texts of a task and a path.
OUTPUTS = "sealed array<struct<pointer: string, output: string>>, declared array<string>"
#: Likewise, where another document stands beside it: digests of subtrees here and there; null where there is no strict one.
BESIDE = "here array<string>, there array<string>"
#: Nodes, and places that documents have in common, that are held at a time besides those of one document.
HELD, PLACES = 20_000, 20_000
KINDS = ("object", "array", "string", "boolean", "integer", "number", "null")
PATHS = ("pointer", "pattern", "parent", "above", "key")


def _sha(text: str) -> str:
    return hashlib.sha256(f"{text}\n".encode()).hexdigest()


def _number(value: float) -> str:
    if value - value != 0:
        raise ValueError("not finite")
    return float.__repr__(value)


#: By the type of a scalar the number of its kind and how it is spelled.
SCALARS = {str: (2, encode_basestring), bool: (3, lambda x: "true" if x else "false"), int: (4, int.__repr__), float: (5, _number), type(None): (6, lambda x: "null")}


def _step(name) -> str:
    return str(name).replace("~", "~0").replace("/", "~1")


def _read(text: str):
    """The value of a text that ``_whole`` must accept as well, once it is spelled: keys are not looked at twice where they can be counted."""
    return canonical.strict(text) if "\\" in text else canonical.plain(text)


def _whole(text: str, own: str) -> None:
    """Refuses what cannot be written as UTF-8, and texts with a key twice: without escapes each colon of a text is in its canonical form as well,
    unless a member was lost."""
    own.isascii() or own.encode()
    if "\\" not in text and text.count(":") != own.count(":"):
        raise canonical.NotStrict("duplicate key")


class _Place:
    """A pointer as documents have it, with what is below it by name or, in arrays, by number, and how its members are spelled by their names and types."""

    __slots__ = ("number", "pointer", "pattern", "told", "members", "forms")

    def __init__(self, number: int, pointer: str, pattern: str, told: bool):
        self.number, self.pointer, self.pattern, self.told, self.members, self.forms = number, pointer, pattern, told, {}, {}


class _Form:
    """Members of some names and types at a place: the spelling of each, the whole and the whole without its seal as templates, rows of scalars."""

    __slots__ = ("names", "spell", "whole", "places", "kinds", "scalar", "told", "seal", "unsealed")


class Nodes:
    """Columns of the nodes of documents; ``told``: the pointers of which digests are asked for, or None for all."""

    def __init__(self, maps: frozenset[str], seal: str, told: frozenset[str] | None = None, bodies: bool = True):
        self.maps, self.seal, self.told, self.bodies = maps, seal, told, bodies
        self.forget()

    def forget(self) -> None:
        self.paths: tuple[list, ...] = ([""], [""], [None], [None], [None])  # pointer, pattern, parent, above, key
        self.forms_held, self.root, self.arrays = 0, _Place(0, "", "", self.told is None or "" in self.told), None
        self.clear()

    def clear(self) -> None:
        self.places, self.kinds, self.values = self.columns = [], [], []
        # by row, where there is one
        self.shas, self.counts, self.sealed_as, self.names, self.seals = self.sparse = {}, {}, {}, {}, {}
        self.forms, self.told_of = {}, {}

    def _below(self, place: _Place, name) -> _Place:
        if (found := place.members.get(name)) is None:
            step, free = _step(name), isinstance(name, int) or place.pattern in self.maps
            step.encode()
            pointer = f"{place.pointer}/{step}"
            found = place.members[name] = _Place(len(self.paths[0]), pointer, f"{place.pattern}/{'*' if free else step}", self.told is None or pointer in self.told)
            for column, x in zip(self.paths, (pointer, found.pattern, place.pointer, place.pattern, str(name)), strict=True):
                column.append(x)
        return found

    def _form(self, place: _Place, names: tuple[str, ...] | None, types: tuple[type, ...]) -> _Form:
        form, braces = _Form(), "{%s}" if names is not None else "[%s]"
        below = [self._below(place, x) for x in (names if names is not None else range(len(types)))]
        scalars = [SCALARS.get(x) for x in types]
        before = [f"{encode_basestring(x)}:".replace("%", "%%") for x in names or ()] or [""] * len(types)
        form.names, form.scalar = names, [x is not None for x in scalars]
        form.spell = [partial(self._visit, x) if scalar is None else scalar[1] for x, scalar in zip(below, scalars, strict=True)]
        form.places, form.kinds = [x.number for x, scalar in zip(below, scalars, strict=True) if scalar], [x[0] for x in scalars if x]
        form.told = [(sum(form.scalar[:i]), i, x) for i, x in enumerate(below) if x.told and scalars[i]]
        form.whole = braces % ",".join(f"{x}%s" for x in before)
        form.seal = names.index(self.seal) if names and self.seal in names else None
        form.unsealed = braces % ",".join(f"{x}%s" for i, x in enumerate(before) if i != form.seal)
        self.forms_held += len(types) + 1
        return form

    def _visit(self, place: _Place, value) -> str:
        places, kinds, values = self.columns
        if type(value) is dict:
            order = tuple(value)
            if (found := place.forms.get(order)) is None:
                names = tuple(sorted(order))
                pick = itemgetter(*names) if len(names) > 1 else lambda x: tuple(x.values())
                found = place.forms[order] = names, pick, {}
            names, pick, forms = found
            items = pick(value)
        else:
            names, items = None, value
            forms = place.forms.setdefault(None, {})
        types = tuple(map(type, items))
        if (form := forms.get(types)) is None:
            form = forms[types] = self._form(place, names, types)
        spelled = [f(x) for f, x in zip(form.spell, items)]  # noqa: B905
        for after, i, below in form.told:
            self._tell(below, spelled[i], after)
        places += form.places
        kinds += form.kinds
        values += compress(spelled, form.scalar)
        own, row = form.whole % tuple(spelled), len(places)
        if names is not None:
            self.names[row] = self.forms.setdefault(names, len(self.forms))
            if form.seal is not None:
                if self.bodies:
                    self.sealed_as[row] = _sha(form.unsealed % tuple(spelled[: form.seal] + spelled[form.seal + 1 :]))
                if form.scalar[form.seal]:
                    self.seals[row] = spelled[form.seal]
        if place.told:
            self._tell(place, own)
        self.counts[row] = len(items)
        places.append(place.number)
        kinds.append(0 if names is not None else 1)
        values.append(None)
        return own

    def _tell(self, place: _Place, own: str, after: int = 0) -> None:
        """Notes the digest of the node that comes next, or after so many others."""
        self.shas[len(self.places) + after] = self.told_of[place.pointer] = _sha(own)

    def add(self, text: str | None):
        """Adds the nodes of a text, its root last; its value in a tuple, or null for one that is not strict JSON or cannot be written as UTF-8."""
        before = len(self.places)
        self.told_of = {}
        if text is None:
            return None
        try:
            value = _read(text)
            if (scalar := SCALARS.get(type(value))) is None:
                own = self._visit(self.root, value)
            else:
                own = scalar[1](value)
                if self.root.told:
                    self._tell(self.root, own)
                for column, x in zip(self.columns, (0, scalar[0], own), strict=True):
                    column.append(x)
            _whole(text, own)
        except (ValueError, OverflowError):
            for column in self.columns:
                del column[before:]
            for column in self.sparse:
                while column and next(reversed(column)) >= before:
                    column.popitem()
            return None
        return (value,)

    def nothing(self) -> None:
        """Adds the row of a text that has no nodes."""
        for column in self.columns:
            column.append(None)

    def arrow(self, fields) -> dict[str, pa.Array]:
        """The named ones of the fields of NODE and MEMBERS, of all nodes added."""
        if self.arrays is None or len(self.arrays["pointer"]) < len(self.paths[0]):
            self.arrays = {name: pa.array(x, pa.string()) for name, x in zip(PATHS, self.paths, strict=True)}
        place, text, rows = pa.array(self.places, pa.int32()), pa.string(), len(self.places)
        out = {name: x.take(place) for name, x in self.arrays.items() if name in fields}
        out |= {"kind": pa.array(KINDS, text).take(pa.array(self.kinds, pa.int32())), "value": pa.array(self.values, text)}
        if "n" in fields:
            out["n"] = pa.array([None if p is None else self.counts.get(i, 0) for i, p in enumerate(self.places)], pa.int64())
        for name, column in (("sha256", self.shas), ("body_sha256", self.sealed_as), ("seal", self.seals)):
            if name in fields:
                out[name] = spread(column, rows, text)
        if "names" in fields:
            out["names"] = pa.array([list(x) for x in self.forms], pa.list_(text)).take(spread(self.names, rows, pa.int32()))
        return out


def spread(column: dict, rows: int, kind: pa.DataType) -> pa.Array:
    """Values by row as a column of so many rows, null elsewhere."""
    out: list = [None] * rows
    for row, x in column.items():
        out[row] = x
    return pa.array(out, kind)


def nodes(text: str | None, maps: frozenset[str], seal: str) -> list[tuple] | None:
    """The nodes of a text, as NODE has them; null for one that is not strict JSON or cannot be written as UTF-8."""
    held = Nodes(maps, seal)
    if held.add(text) is None:
        return None
    names = [x.split()[0] for x in NODE.split(", ")]
    columns = held.arrow(names)
    return list(zip(*(columns[x].to_pylist() for x in names), strict=True))


def under(value, pattern: str, maps: frozenset[str]) -> Iterator[tuple[str, object]]:
    """Pointers and values of the places of a pattern."""
    found = [("", value)]
    above = ""
    for step in pattern.split("/")[1:]:
        below = []
        for pointer, x in found:
            if isinstance(x, list):
                below += [(f"{pointer}/{i}", y) for i, y in enumerate(x)] if step == "*" else []
            elif isinstance(x, dict) and above in maps:
                below += [(f"{pointer}/{_step(k)}", x[k]) for k in sorted(x)] if step == "*" else []
            elif isinstance(x, dict) and (k := step.replace("~1", "/").replace("~0", "~")) in x:
                below.append((f"{pointer}/{step}", x[k]))
        found, above = below, f"{above}/{step}"
    yield from found


def _text(value) -> str | None:
    """A text as such, other scalars in canonical form."""
    return value if isinstance(value, str) else SCALARS[type(value)][1](value) if type(value) in SCALARS else None


def _output(task: str | None, path: str | None) -> str | None:
    return None if task is None or path is None else f"[{encode_basestring(task)},{encode_basestring(path)}]"


def sealed(value, maps: frozenset[str], pattern: str = "/verified_outputs/*") -> list[dict]:
    """The outputs that a document seals: their pointer, and task and path as one text (null without either)."""
    fields = lambda x: (_text(x.get("task_id", ())), _text(x.get("path", ()))) if isinstance(x, dict) else (None, None)
    return [{"pointer": at, "output": _output(*fields(x))} for at, x in under(value, pattern, maps) if x and isinstance(x, (dict, list))]


def declared(value, maps: frozenset[str], pattern: str = "/suite/tasks/*") -> list[str]:
    """The outputs that the tasks of a document declare, spelled likewise."""
    out = []
    for _, task in under(value, pattern, maps):
        if isinstance(task, dict) and isinstance(of := task.get("outputs"), (dict, list)):
            paths = of if isinstance(of, list) else of.values()
            out += [_output(_text(task.get("id", ())), _text(x)) for x in paths if x is not None]
    return [x for x in out if x is not None]


_SPELL = json.JSONEncoder(ensure_ascii=False, sort_keys=True, separators=(",", ":"), allow_nan=False).encode


def _spelled(value) -> str:
    scalar = SCALARS.get(type(value))
    return _SPELL(value) if scalar is None else scalar[1](value)


def digests(text: str | None, pointers: tuple[str, ...], maps: frozenset[str]) -> tuple[list, list] | None:
    """Digests of the subtrees at pointers and the outputs declared, without the nodes; null as for ``nodes``."""
    if text is None:
        return None
    try:
        value = _read(text)
        fields = {f"/{_step(k)}": _spelled(x) for k, x in value.items()} if isinstance(value, dict) else {}
        # of an object the spelled fields say what the whole would, but for the colons of its own keys
        _whole(text, "".join(f"{k}:{x}" for k, x in fields.items()) if isinstance(value, dict) else _spelled(value))
    except (ValueError, OverflowError):
        return None
    found = [fields.get(x) if x.count("/") == 1 and isinstance(value, dict) else next((_spelled(y) for y in at(value, x)), None) for x in pointers]
    return [None if x is None else _sha(x) for x in found], declared(value, maps)


def at(value, pointer: str) -> list:
    """The value at a pointer, if there is one."""
    for step in pointer.split("/")[1:]:
        name = step.replace("~1", "/").replace("~0", "~")
        if isinstance(value, dict) and name in value:
            value = value[name]
        elif isinstance(value, list) and name.isdecimal() and name == str(int(name)) and int(name) < len(value):
            value = value[int(name)]
        else:
            return []
    return [value]


def flattened(docs: DataFrame, key: str, text: str, maps: tuple[str, ...] = (), seal: str = "context_sha256", beside: str | None = None, pairs: tuple[tuple[str, str], ...] = (), fields: tuple[str, ...] | None = None) -> DataFrame:
    """Per node of each document: the key and the fields of NODE, MEMBERS and OUTPUTS, or those that are named; a text that is not strict has one
    row without a pointer. Texts are read once, and their nodes go out as columns.

    With ``beside``, the column of another document: also BESIDE, digests at the first and second pointers of pairs; declared are its outputs."""
    source = docs.select(key, text, *([beside] if beside else []))
    schema = T.StructType.fromDDL(f"{NODE}, {MEMBERS}, {OUTPUTS}" + (f", {BESIDE}" if beside else ""))
    schema = T.StructType([f for f in schema if fields is None or f.name in fields])
    types, free = {f.name: to_arrow_type(f.dataType) for f in schema}, frozenset(maps)
    here, there = tuple(x[0] for x in pairs), tuple(x[1] for x in pairs)
    told = None if "sha256" in types else frozenset(here)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = Nodes(free, seal, told, "body_sha256" in types)
        for batch in batches:
            at, roots, last = [], {}, batch.num_rows - 1
            others = batch.column(2).to_pylist() if beside else repeat(None)
            for i, (x, other) in enumerate(zip(batch.column(1).to_pylist(), others, strict=bool(beside))):
                if (found := held.add(x)) is None:
                    held.nothing()
                else:
                    own = {"sealed": sealed(found[0], free)}
                    if beside:
                        own["here"] = [held.told_of.get(p) for p in here]
                        own["there"], own["declared"] = digests(other, there, free) or (None, None)
                    else:
                        own["declared"] = declared(found[0], free)
                    roots[len(held.places) - 1] = own
                at.extend(repeat(i, len(held.places) - len(at)))
                if len(at) >= HELD or i == last:
                    columns = {key: batch.column(0).take(pa.array(at, pa.int32())), **held.arrow(types)}
                    for name in ("sealed", "declared", "here", "there"):
                        if name in types:
                            columns[name] = spread({n: own[name] for n, own in roots.items()}, len(at), types[name])
                    yield pa.RecordBatch.from_arrays([columns[n] for n in (key, *types)], names=[key, *types])
                    at, roots = [], {}
                    held.forget() if max(len(held.paths[0]), held.forms_held) > PLACES else held.clear()

    return source.mapInArrow(rows, T.StructType([T.StructField(key, source.schema[0].dataType), *schema]))
