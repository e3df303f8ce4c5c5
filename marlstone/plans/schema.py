"""Models, relations and the schema language, as Spark schemas and metadata."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from .errors import InvalidQuery

# Built-in scalar types and what they are in Spark. Decimals keep 38 digits, 18 of them after the point.
SCALARS: dict[str, T.DataType] = {
    "String": T.StringType(), "Boolean": T.BooleanType(), "Int": T.IntegerType(), "BigInt": T.LongType(), "Float": T.DoubleType(),
    "Decimal": T.DecimalType(38, 18), "DateTime": T.TimestampNTZType(), "Json": T.StringType(), "Bytes": T.BinaryType(),
}
# Native type annotations that narrow a scalar.
NATIVE: dict[str, T.DataType] = {
    "SmallInt": T.ShortType(), "TinyInt": T.ByteType(), "Integer": T.IntegerType(), "Int": T.IntegerType(), "BigInt": T.LongType(), "Real": T.FloatType(),
    "DoublePrecision": T.DoubleType(), "Date": T.DateType(), "Timestamp": T.TimestampNTZType(), "Timestamptz": T.TimestampType(), "Money": T.DecimalType(19, 4),
    "Uuid": T.StringType(), "Inet": T.StringType(), "Xml": T.StringType(), "Citext": T.StringType(), "Text": T.StringType(), "VarChar": T.StringType(), "Char": T.StringType(), "ByteA": T.BinaryType(),
}


@dataclass(frozen=True)
class Field:
    name: str
    type: str
    required: bool = True
    is_list: bool = False
    unique: bool = False
    is_id: bool = False
    default: str | None = None
    column: str | None = None
    native: str | None = None
    updated_at: bool = False

    @property
    def column_name(self) -> str:
        return self.column or self.name


@dataclass(frozen=True)
class Relation:
    """from_model.from_key = to_model.to_key; many: a parent has many; junction: (table, key to parent, key to child).

    owner: whether from_model holds the foreign key; where it isn't given, the side that has one related row does.
    default: what SetDefault sets. on_delete and on_update say what happens to the owner's rows.
    """

    name: str
    from_model: str
    from_key: str
    to_model: str
    to_key: str
    many: bool = False
    junction: tuple[str, str, str] | None = None
    on_delete: str = "NoAction"
    on_update: str = "Cascade"
    owner: bool | None = None
    default: object = None

    @property
    def refers(self) -> bool:
        """Whether rows of from_model hold the key of the row they relate to."""
        return self.junction is None and (not self.many if self.owner is None else self.owner)


@dataclass(frozen=True)
class Model:
    name: str
    fields: tuple[Field, ...]
    table: str | None = None
    keys: tuple[str, ...] = ()
    uniques: tuple[tuple[str, ...], ...] = ()
    indexes: tuple[tuple[str, ...], ...] = ()
    is_view: bool = False

    @property
    def table_name(self) -> str:
        return self.table or self.name

    def field(self, name: str) -> Field:
        for f in self.fields:
            if f.name == name:
                return f
        raise InvalidQuery(f"{self.name} has no field {name}")


@dataclass
class Schema:
    models: dict[str, Model] = field(default_factory=dict)
    enums: dict[str, tuple[str, ...]] = field(default_factory=dict)
    relations: dict[tuple[str, str], Relation] = field(default_factory=dict)
    blocks: dict[str, dict[str, str]] = field(default_factory=dict)
    overrides: dict[str, T.DataType] = field(default_factory=dict)
    composites: set[str] = field(default_factory=set)

    def struct(self, model: str) -> T.StructType:
        """The model's scalar columns; unique, default and allowed values are kept as metadata."""
        out = T.StructType()
        for f in self.models[model].fields:
            kind = self.scalar(f)
            if kind is None:
                continue
            notes = {k: v for k, v in {"unique": f.unique or f.is_id, "default": f.default, "values": list(self.enums.get(f.type, ()))}.items() if v}
            out.add(T.StructField(f.column_name, T.ArrayType(kind, False) if f.is_list else kind, not f.required, notes))
        return out

    def scalar(self, f: Field) -> T.DataType | None:
        if f.type in self.overrides:
            return self.overrides[f.type]
        if f.native:
            name, _, args = f.native.partition("(")
            if name in ("Decimal", "Numeric", "Money") and args:
                p, _, s = args.rstrip(")").partition(",")
                return T.DecimalType(min(38, int(p)), min(18, int(s or 0)))
            if name in NATIVE:
                return NATIVE[name]
        if f.type in self.enums or f.type.startswith("Unsupported"):
            return T.StringType()
        return SCALARS.get(f.type)


_BLOCK = re.compile(r"\b(model|enum|view|type|datasource|generator)\s+(\w+)\s*\{([^{}]*)\}")
_FIELD = re.compile(r'(\w+)\s+(Unsupported\("[^"]*"\)|\w+)(\[\])?(\?)?(.*)')
_ATTRIBUTE = re.compile(r"@(@?[\w.]+)(\((?:[^()]|\([^()]*\))*\))?")
# Referential actions of the schema language.
ACTIONS = ("Cascade", "Restrict", "NoAction", "SetNull", "SetDefault")


def _list_of(args: str) -> tuple[str, ...]:
    m = re.search(r"\[([^\]]*)\]", args)
    return tuple(x.strip() for x in m[1].split(",") if x.strip()) if m else ()


def _named(args: str, name: str) -> str | None:
    m = re.search(rf"\b{name}\s*:\s*(\[[^\]]*\]|\"[^\"]*\"|[\w.]+)", args)
    return m[1].strip('"') if m else None


def _name_of(args: str) -> str | None:
    """The name of a relation: a quoted first argument, or name: "..."."""
    m = re.match(r'\(\s*"([^"]*)"', args)
    return m[1] if m else _named(args, "name")


@dataclass(frozen=True)
class _Side:
    """A field whose type is a model, as written."""

    model: str
    field: Field
    name: str | None
    own: tuple[str, ...]
    theirs: tuple[str, ...]
    on_delete: str
    on_update: str


def _read_model(kind: str, name: str, body: str) -> tuple[Model, dict[str, str]]:
    """A model, and what its fields' @relation attributes say."""
    fields, table, keys, uniques, indexes, said = [], None, (), [], [], {}
    for line in filter(None, map(str.strip, body.splitlines())):
        if line.startswith("@@"):
            attribute, args = _ATTRIBUTE.match(line).groups()
            if attribute == "@map":
                table = args.strip('()" ')
            elif attribute == "@id":
                keys = _list_of(args)
            elif attribute == "@unique":
                uniques.append(_list_of(args))
            elif attribute in ("@index", "@fulltext"):
                indexes.append(_list_of(args))
            continue
        m = _FIELD.match(line)
        if not m:
            raise InvalidQuery(f"{name}: cannot read {line!r}")
        fname, ftype, is_list, optional, rest = m.groups()
        notes = dict(_ATTRIBUTE.findall(rest))
        if "ignore" in notes:
            continue
        native = next((k[3:] + v for k, v in notes.items() if k.startswith("db.")), None)
        default = notes.get("default")
        column = notes["map"].strip('()" ') if "map" in notes else None
        fields.append(Field(fname, ftype, not optional, bool(is_list), "unique" in notes, "id" in notes, default[1:-1] if default else None, column, native, "updatedAt" in notes))
        if "relation" in notes:
            said[fname] = notes["relation"]
    keys = keys or tuple(f.name for f in fields if f.is_id)
    return Model(name, tuple(fields), table, keys, tuple(uniques), tuple(indexes), kind == "view"), said


def _literal(schema: Schema, f: Field) -> object:
    """The default of a field where it is a plain value."""
    text = f.default
    if text is None or re.fullmatch(r"\w+\(.*\)", text, re.S):
        return None
    if text.startswith('"'):
        return text[1:-1]
    if text in ("true", "false"):
        return text == "true"
    if f.type in schema.enums:
        return text
    try:
        return int(text) if re.fullmatch(r"[+-]?\d+", text) else float(text)
    except ValueError:
        return None


def _relate(out: Schema, sides: list[_Side]) -> None:
    """Pairs the fields that point at each other, by relation name where one is given."""
    for s in sides:
        target = out.models[s.field.type]
        back = [b for b in sides if b.model == s.field.type and b.field.type == s.model and b.name == s.name and b is not s]
        if s.own:
            if len(s.own) != 1 or len(s.theirs) != 1:
                raise InvalidQuery(f"{s.model}.{s.field.name}: a relation over {len(s.own)} columns; relations have one column here")
            unknown = [f"{m}.{c}" for m, c in ((s.model, s.own[0]), (target.name, s.theirs[0])) if c not in {f.name for f in out.models[m].fields}]
            if unknown:
                raise InvalidQuery(f"{s.model}.{s.field.name}: no field {', '.join(unknown)}")
            own, theirs = out.models[s.model].field(s.own[0]), target.field(s.theirs[0])
            named = (s.on_delete, s.on_update)
            out.relations[s.model, s.field.name] = Relation(s.field.name, s.model, own.column_name, target.name, theirs.column_name, False, None, *named, True, _literal(out, own))
            if len(back) > 1:
                raise InvalidQuery(f"{target.name} has {len(back)} fields for {s.model}.{s.field.name}; give the relations names")
            for b in back:
                out.relations[target.name, b.field.name] = Relation(b.field.name, target.name, theirs.column_name, s.model, own.column_name, b.field.is_list, None, *named, False, _literal(out, own))
        elif s.field.is_list and len(back) == 1 and back[0].field.is_list and not back[0].own:
            # both sides are lists: a junction named after the models in name order, with columns A and B
            first, second = sorted((s.model, target.name))
            swapped = s.model != first or (s.model == target.name and s.field.name > back[0].field.name)
            keys = [out.models[m].field(out.models[m].keys[0]).column_name for m in (s.model, target.name)]
            junction = (f"_{s.name or f'{first}To{second}'}", *(("B", "A") if swapped else ("A", "B")))
            out.relations[s.model, s.field.name] = Relation(s.field.name, s.model, keys[0], target.name, keys[1], True, junction)


def parse_schema(text: str) -> Schema:
    """Reads models, enums, views and composite types with their attributes.

    Relations come from @relation(fields, references), paired with the field of the other model that points back (of the
    same relation name, if there is one); two lists that point at each other are a relation through a junction. A
    relation over several columns is refused.
    """
    out = Schema()
    text = re.sub(r'("[^"\n]*")|//[^\n]*', lambda m: m[1] or "", text)
    found = _BLOCK.findall(text)
    names = [name for kind, name, _ in found if kind not in ("datasource", "generator")]
    twice = sorted({n for n in names if names.count(n) > 1})
    if twice:
        raise InvalidQuery(f"defined twice: {', '.join(twice)}")
    out.enums = {name: tuple(v for line in body.splitlines() for v in re.findall(r"\w+", line.partition("@")[0])) for kind, name, body in found if kind == "enum"}
    said: dict[str, dict[str, str]] = {}
    for kind, name, body in found:
        if kind in ("datasource", "generator"):
            out.blocks[name] = dict(re.findall(r'(\w+)\s*=\s*("[^"]*"|[^\n]+)', body))
        elif kind != "enum":
            out.models[name], said[name] = _read_model(kind, name, body)
            if kind == "type":
                out.composites.add(name)
    sides = []
    for m in out.models.values():
        for f in m.fields:
            if f.type in out.models and f.type not in out.composites:
                args = said[m.name].get(f.name, "")
                names = [_list_of(_named(args, k) or "") for k in ("fields", "references")]
                optional = all(not m.field(x).required for x in names[0] if x in {g.name for g in m.fields})
                sides.append(_Side(m.name, f, _name_of(args), *names, _named(args, "onDelete") or ("SetNull" if names[0] and optional else "NoAction"), _named(args, "onUpdate") or "Cascade"))
    problems = validate(out)
    if problems:
        raise InvalidQuery("; ".join(problems))
    _relate(out, sides)
    problems = validate_relations(out)
    if problems:
        raise InvalidQuery("; ".join(problems))
    return out


# Which scalars a default function and a native type may stand on.
_DEFAULT_OF = {
    "now": {"DateTime"}, "uuid": {"String"}, "cuid": {"String"}, "cuid2": {"String"}, "nanoid": {"String"}, "ulid": {"String"},
    "autoincrement": {"Int", "BigInt"}, "sequence": {"Int", "BigInt"},
}
_NATIVE_OF = {
    "String": {"Uuid", "Inet", "Xml", "Citext", "Text", "VarChar", "Char", "Bit", "VarBit"}, "Boolean": {"Boolean"}, "Int": {"SmallInt", "TinyInt", "Integer", "Int", "Oid"},
    "BigInt": {"BigInt"}, "Float": {"Real", "DoublePrecision"}, "Decimal": {"Decimal", "Numeric", "Money"},
    "DateTime": {"Date", "Timestamp", "Timestamptz", "Time", "Timetz"}, "Json": {"Json", "JsonB"}, "Bytes": {"ByteA"},
}


def _default_problem(schema: Schema, f: Field) -> str | None:
    """What is wrong with a field's default, if anything."""
    text = f.default
    if text is None or text.startswith("dbgenerated(") or text.startswith("auto("):
        return None
    if f.is_list:
        return None if text.startswith("[") and text.endswith("]") else "the default of a list is no list"
    m = re.fullmatch(r"(\w+)\((.*)\)", text, re.S)
    if m:
        if m[1] not in _DEFAULT_OF:
            return f"unknown default function {m[1]}"
        return None if f.type in _DEFAULT_OF[m[1]] else f"{m[1]}() is no default of {f.type}"
    if f.type in schema.enums:
        return None if text in schema.enums[f.type] else f"{text} is no value of {f.type}"
    kinds = {"Boolean": r"true|false", "Int": r"[+-]?\d+", "BigInt": r"[+-]?\d+", "Float": r"[+-]?\d+(\.\d+)?([eE][+-]?\d+)?", "Decimal": r"[+-]?\d+(\.\d+)?"}
    return None if re.fullmatch(kinds.get(f.type, r'"(?:[^"\\]|\\.)*"'), text, re.S) else f"{text} is no default of {f.type}"


def _field_problems(schema: Schema, m: Model, f: Field) -> list[str]:
    out = []
    if f.type in schema.models:
        return out
    if schema.scalar(f) is None:
        return [f"unknown type {f.type}"]
    if f.is_id and (not f.required or f.is_list):
        out.append("a key can be neither optional nor a list")
    if f.is_list and not f.required:
        out.append("a list can't be optional")
    if f.updated_at and f.type != "DateTime":
        out.append("@updatedAt needs a DateTime")
    if f.updated_at and f.is_list:
        out.append("@updatedAt on a list")
    if problem := _default_problem(schema, f):
        out.append(problem)
    if f.native and f.type in _NATIVE_OF and f.native.partition("(")[0] not in _NATIVE_OF[f.type]:
        out.append(f"native type {f.native} is none of {f.type}")
    return out


def validate(schema: Schema) -> list[str]:
    """Problems of models and enums by themselves: types, names, keys, indexes, defaults and native types."""
    out = [f"enum {name} has no values" for name, values in schema.enums.items() if not values]
    out += [f"enum {name}: {v} is there twice" for name, values in schema.enums.items() for v in sorted({v for v in values if values.count(v) > 1})]
    tables = [m.table_name for m in schema.models.values() if m.name not in schema.composites]
    out += [f"two models are mapped to {t}" for t in sorted({t for t in tables if tables.count(t) > 1})]
    for m in schema.models.values():
        names = [f.column_name.lower() for f in m.fields if f.type not in schema.models]
        out += [f"{m.name}: column {n} is there twice" for n in sorted({n for n in names if names.count(n) > 1})]
        out += [f"{m.name}.{f.name}: {p}" for f in m.fields for p in _field_problems(schema, m, f)]
        known = {f.name: f for f in m.fields}
        for group in (m.keys, *m.uniques, *m.indexes):
            bare = [k.partition("(")[0].partition(".")[0] for k in group]
            out += [f"{m.name}: no field {k}" for k in bare if k not in known]
            out += [f"{m.name}: {k} is a relation, index its column" for k in bare if k in known and known[k].type in schema.models and known[k].type not in schema.composites]
            out += [f"{m.name}: {k} is in one index twice" for k in sorted({k for k in bare if bare.count(k) > 1})]
        if sum(f.is_id for f in m.fields) > 1:
            out.append(f"{m.name}: more than one @id; use @@id")
        unique = m.keys or m.uniques or any(f.unique for f in m.fields)
        if not unique and not m.is_view and m.name not in schema.composites:
            out.append(f"{m.name}: no key and no unique field")
    return out


def validate_relations(schema: Schema) -> list[str]:
    """Problems of relations: actions, types of the two columns, what they refer to, fields without an opposite."""
    out = []
    for (model, name), r in schema.relations.items():
        where = f"{model}.{name}"
        out += [f"{where}: no such action {a}" for a in (r.on_delete, r.on_update) if a not in ACTIONS]
        if not r.refers:
            continue
        own, theirs = (next(f for f in schema.models[m].fields if f.column_name == c) for m, c in ((model, r.from_key), (r.to_model, r.to_key)))
        target = schema.models[r.to_model]
        if schema.scalar(own) != schema.scalar(theirs) or own.is_list or theirs.is_list:
            out.append(f"{where}: {own.name} and {theirs.name} differ in type")
        if not (theirs.is_id or theirs.unique or target.keys == (theirs.name,) or (theirs.name,) in target.uniques):
            out.append(f"{where}: {target.name}.{theirs.name} is not unique")
        if "SetNull" in (r.on_delete, r.on_update) and own.required:
            out.append(f"{where}: SetNull on the required field {own.name}")
        if "SetDefault" in (r.on_delete, r.on_update) and r.default is None:
            out.append(f"{where}: SetDefault without a plain default of {own.name}")
    for m in schema.models.values():
        if m.name in schema.composites:
            continue
        for f in m.fields:
            if f.type in schema.models and f.type not in schema.composites and (m.name, f.name) not in schema.relations:
                out.append(f"{m.name}.{f.name}: no field of {f.type} is its opposite, and it has no @relation(fields, references)")
    return out


def infer_relations(schemas: dict[str, T.StructType], foreign: dict[tuple[str, str], tuple[str, str]], unique: set[tuple[str, str]] = frozenset()) -> dict[tuple[str, str], Relation]:
    """From (table, column) -> (table, column): the child's side, and the parent's, many unless the child's column is unique.

    Each side is named after the other table; where several columns of a table refer to the same one, after table and column.
    """
    out = {}
    pairs = [(child, parent) for (child, _), (parent, _) in foreign.items()]
    for (child, key), (parent, ref) in foreign.items():
        if key not in schemas[child].names or ref not in schemas[parent].names:
            raise InvalidQuery(f"no such columns: {child}.{key} -> {parent}.{ref}")
        several = pairs.count((child, parent)) > 1 or child == parent
        up, down = (f"{parent}_by_{key}", f"{child}_of_{key}") if several else (parent, child)
        out[child, up] = Relation(up, child, key, parent, ref, owner=True)
        out[parent, down] = Relation(down, parent, ref, child, key, (child, key) not in unique, owner=False)
    return out


@dataclass(frozen=True)
class SchemaChange:
    kind: str
    table: str
    column: str | None = None
    detail: str = ""


def diff_schemas(old: dict[str, T.StructType], new: dict[str, T.StructType]) -> list[SchemaChange]:
    """Tables and columns added, dropped or changed in type or nullability, in name order."""
    out = [SchemaChange("create_table", t) for t in sorted(new.keys() - old.keys())] + [SchemaChange("drop_table", t) for t in sorted(old.keys() - new.keys())]
    for t in sorted(old.keys() & new.keys()):
        a, b = {f.name: f for f in old[t]}, {f.name: f for f in new[t]}
        out += [SchemaChange("add_column", t, c, b[c].dataType.simpleString()) for c in sorted(b.keys() - a.keys())]
        out += [SchemaChange("drop_column", t, c) for c in sorted(a.keys() - b.keys())]
        for c in sorted(a.keys() & b.keys()):
            if a[c].dataType != b[c].dataType:
                out.append(SchemaChange("alter_type", t, c, f"{a[c].dataType.simpleString()} -> {b[c].dataType.simpleString()}"))
            if a[c].nullable != b[c].nullable:
                out.append(SchemaChange("alter_nullable", t, c, str(b[c].nullable)))
            was, now = a[c].metadata.get("default"), b[c].metadata.get("default")
            if was != now:
                out.append(SchemaChange("alter_default", t, c, f"{was} -> {now}"))
    return out


def _indexes(schema: Schema, m: Model) -> dict[tuple[bool, tuple[str, ...]], str]:
    """(unique, columns) -> name of the model's indexes, the key's left out."""
    column = lambda k: m.field(k.partition("(")[0]).column_name
    found = [(True, (f.column_name,)) for f in m.fields if f.unique] + [(True, tuple(map(column, u))) for u in m.uniques] + [(False, tuple(map(column, i))) for i in m.indexes]
    return {x: "_".join((m.table_name, *x[1], "key" if x[0] else "idx")) for x in found}


# The order in which kinds of changes are made, so that each finds what it needs.
_STEPS = (
    "drop_foreign_key", "drop_index", "create_enum", "alter_enum", "drop_table", "create_table", "drop_column", "add_column", "alter_type", "alter_nullable", "alter_default",
    "redefine_key", "rename_index", "create_index", "rename_foreign_key", "create_foreign_key", "drop_enum",
)


def diff_models(old: Schema, new: Schema) -> list[SchemaChange]:
    """All changes between two parsed schemas, in an order in which they can be made.

    Beside what diff_schemas finds: keys, indexes (renamed ones, which cover the same columns of a renamed table, among them),
    foreign keys with their actions, and enums. A model that keeps its name but is mapped to another table is a new table.
    """
    tables = [{m.table_name: s.struct(m.name) for m in s.models.values() if not m.is_view and m.name not in s.composites} for s in (old, new)]
    out = diff_schemas(*tables)
    models = [{m.table_name: m for m in s.models.values()} for s in (old, new)]
    for t in sorted(tables[0].keys() | tables[1].keys()):
        was, now = (_indexes(s, by[t]) if t in by else {} for s, by in zip((old, new), models, strict=True))
        out += [SchemaChange("drop_index", t, ",".join(k[1]), n) for k, n in was.items() if k not in now and t in tables[1]]
        out += [SchemaChange("create_index", t, ",".join(k[1]), n) for k, n in now.items() if k not in was]
        out += [SchemaChange("rename_index", t, ",".join(k[1]), f"{was[k]} -> {n}") for k, n in now.items() if k in was and was[k] != n]
        if t in models[0] and t in models[1] and models[0][t].keys != models[1][t].keys:
            out.append(SchemaChange("redefine_key", t, None, ",".join(models[1][t].keys)))
    keys = [{(s.models[m].table_name, r.from_key, s.models[r.to_model].table_name, r.to_key, r.on_delete, r.on_update): n for (m, n), r in s.relations.items() if r.refers} for s in (old, new)]
    label = lambda k: f"{k[2]}.{k[3]} {k[4]}/{k[5]}"
    out += [SchemaChange("drop_foreign_key", k[0], k[1], label(k)) for k in keys[0] if k not in keys[1] and k[0] in tables[1]]
    out += [SchemaChange("create_foreign_key", k[0], k[1], label(k)) for k in keys[1] if k not in keys[0]]
    out += [SchemaChange("rename_foreign_key", k[0], k[1], f"{keys[0][k]} -> {n}") for k, n in keys[1].items() if k in keys[0] and keys[0][k] != n]
    out += [SchemaChange("create_enum", e) for e in sorted(new.enums.keys() - old.enums.keys())] + [SchemaChange("drop_enum", e) for e in sorted(old.enums.keys() - new.enums.keys())]
    out += [SchemaChange("alter_enum", e, None, ",".join(new.enums[e])) for e in sorted(old.enums.keys() & new.enums.keys()) if old.enums[e] != new.enums[e]]
    return ordered_changes(out)


def ordered_changes(changes: list[SchemaChange]) -> list[SchemaChange]:
    """Links and indexes go first and come last, so no step meets a column that isn't there."""
    return sorted(changes, key=lambda c: (_STEPS.index(c.kind), c.table, c.column or "", c.detail))


class Catalog:
    """Tables by model name, with the relations between them."""

    def __init__(self, spark: SparkSession, tables: dict[str, DataFrame] | None = None, relations: dict[tuple[str, str], Relation] | None = None, keys: dict[str, tuple[str, ...]] | None = None):
        self.spark, self.tables = spark, dict(tables or {})
        self.relations, self.keys = dict(relations or {}), dict(keys or {})

    def table(self, name: str) -> DataFrame:
        return self.tables[name] if name in self.tables else self.spark.table(name)

    def relation(self, model: str, name: str) -> Relation:
        try:
            return self.relations[model, name]
        except KeyError:
            raise InvalidQuery(f"{model} has no relation {name}") from None

    def key(self, model: str) -> tuple[str, ...]:
        return self.keys.get(model, (self.table(model).columns[0],))

    def with_table(self, name: str, df: DataFrame) -> Catalog:
        return Catalog(self.spark, {**self.tables, name: df}, self.relations, self.keys)

    def register_views(self) -> None:
        for name, df in self.tables.items():
            df.createOrReplaceTempView(name)

    def introspect(self) -> dict[str, T.StructType]:
        """Schemas of the catalog's tables and of the session's."""
        names = {t.name for t in self.spark.catalog.listTables()} | self.tables.keys()
        return {n: self.table(n).schema for n in sorted(names)}

    def introspect_models(self) -> Schema:
        """Models with keys, column types and relations, as far as the catalog knows them; a table without a declared key has none."""
        names = {v: k for k, v in reversed(SCALARS.items())} | {T.StringType(): "String", T.ShortType(): "Int", T.ByteType(): "Int", T.FloatType(): "Float", T.DateType(): "DateTime", T.TimestampType(): "DateTime"}
        out = Schema(relations=dict(self.relations))
        for name, schema in self.introspect().items():
            fields = []
            for f in schema:
                kind = f.dataType.elementType if isinstance(f.dataType, T.ArrayType) else f.dataType
                shown = "Decimal" if isinstance(kind, T.DecimalType) else names.get(kind, f'Unsupported("{kind.simpleString()}")')
                fields.append(Field(f.name, shown, not f.nullable, isinstance(f.dataType, T.ArrayType), is_id=self.keys.get(name) == (f.name,)))
            foreign = tuple((r.from_key,) for (m, _), r in self.relations.items() if m == name and r.refers)
            out.models[name] = Model(name, tuple(fields), keys=self.keys.get(name, ()), indexes=foreign)
        return out
