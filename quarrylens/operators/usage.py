"""Usage search over fact tables of source code: who uses a type, calls a method, holds a field, deletes for good.

types(fqn, name, kind, is_entity), members(class_fqn, member, kind, type_text, param_names), calls(caller, method, scope, callee, pos, args),
locals(caller, name, type_text, pos), fields(class_fqn, name, type_text), annotations(target, member, name, fqn).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarrylens.functions.lineage import cut
from quarrylens.operators.sqlop import SqlOp

#: Substrings that make a field's type a collection, and the repository methods that delete rows for good.
COLLECTIONS = ("List", "Set", "Map", "Collection", "Queue", "Deque")
DELETES = ("delete", "deleteById", "deleteAll", "deleteAllById", "deleteInBatch", "deleteAllInBatch", "deleteAllByIdInBatch")

COLLECTION_FIELDS = SqlOp(
    "Fields of collection types in classes that are no entity and no dto.",
    f"""
SELECT f.class_fqn, f.type_text, f.name FROM {{fields}} f JOIN {{types}} t ON t.fqn = f.class_fqn
WHERE NOT t.is_entity AND instr(lower(f.class_fqn), 'dto') = 0 AND ({" OR ".join(f"instr(f.type_text, '{c}') > 0" for c in COLLECTIONS)})""",
)
COLLECTION_COUNT = SqlOp("How many such fields.", "SELECT count(*) AS n FROM {found}")
SCOPE_TYPES = SqlOp(
    "The type a call's scope name has: the last local of that name declared before the call, else the parameter's, else the field's, else the name itself. An as-of join as one pass over calls and locals in order.",
    """
WITH seen AS (
  SELECT call_id, caller, method, callee, scope AS name, pos, false AS is_local, CAST(NULL AS STRING) AS type_text FROM {calls}
  UNION ALL SELECT NULL, caller, method, NULL, name, pos, true, type_text FROM {locals}
), latest AS (
  SELECT *, last_value(type_text, true) OVER (PARTITION BY caller, method, name ORDER BY pos, is_local, type_text
    ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS local_type
  FROM seen
), p AS (SELECT caller, method, name, max(type_text) AS param_type FROM {params} GROUP BY caller, method, name),
f AS (SELECT class_fqn AS caller, name, max(type_text) AS field_type FROM {fields} GROUP BY class_fqn, name)
SELECT l.call_id, l.caller, l.method, l.callee, coalesce(l.local_type, p.param_type, f.field_type, l.name) AS scope_type
FROM latest l LEFT JOIN p ON p.caller = l.caller AND p.method = l.method AND p.name = l.name LEFT JOIN f ON f.caller = l.caller AND f.name = l.name
WHERE NOT l.is_local""",
)
METHOD_USAGES = SqlOp(
    "Calls of asked (class_name, method) by the type of their scope; a method reference's caller ends in [ref]. Initializers are methods <init> and <clinit>. Sorted by caller and method by whoever shows them.",
    """
SELECT a.class_name, a.method AS target, s.caller, concat(s.method, CASE WHEN r.call_id IS NULL THEN '' ELSE '[ref]' END) AS method
FROM {scoped} s JOIN {asked} a ON a.method = s.callee AND a.class_name = s.scope_type LEFT JOIN {refs} r ON r.call_id = s.call_id""",
)
CLASS_USAGES = SqlOp(
    "Uses of each asked type, itself left out: extended, implemented, as field, parameter or return type; once each.",
    """
SELECT DISTINCT a.name AS target, m.class_fqn AS using_class, m.kind, m.member
FROM {members} m JOIN {asked} a ON a.name = m.base_type AND a.name <> m.class_fqn""",
)
ANNOTATED = SqlOp(
    "Classes and methods with an annotation: exact, by simple name, or by dotted suffix. Each name gives its dotted suffixes, so that all is one join on equal names.",
    """
WITH names AS (
  SELECT DISTINCT target, member, explode(array_append(transform(sequence(1, size(split(coalesce(fqn, ''), '[.]'))), k -> array_join(slice(split(coalesce(fqn, ''), '[.]'), k, 1000000), '.')), name)) AS name
  FROM {annotations}
)
SELECT DISTINCT n.target, n.member FROM names n JOIN {asked} q ON q.name = n.name""",
)
FIELD_DEPENDENCIES = SqlOp("Type to each class that holds a field of it.", "SELECT DISTINCT type_text AS target, class_fqn AS cls, name AS field FROM {fields}")
CALL_INDEX = SqlOp(
    "Callers of a type's methods over fields: plain, by this, under verify, when or given, and by method references, whose scope is the part before the colons.",
    r"""
WITH scoped AS (
  SELECT caller, callee, regexp_extract(scope, '^(?:this[.])?([A-Za-z_$][A-Za-z0-9_$]*)$', 1) AS plain,
    regexp_extract(scope, '(?:^|[.])(?:verify|when|given)[(]\s*(?:this[.])?([A-Za-z_$][A-Za-z0-9_$]*)\s*(?:[)]|,.*[)])$', 1) AS stubbed
  FROM {calls}
)
SELECT DISTINCT d.target AS repo, c.callee AS method, c.caller, d.field
FROM (SELECT caller, callee, CASE WHEN plain <> '' THEN plain ELSE stubbed END AS field FROM scoped) c JOIN {deps} d ON d.cls = c.caller AND d.field = c.field""",
)
INDEXED_METHODS = SqlOp("Methods of each type that are called.", "SELECT DISTINCT repo, method FROM {index}")
REWRITES = SqlOp(
    "Classes that call a renamed method, and which.",
    """
SELECT i.caller, string_agg(DISTINCT i.method, ',') WITHIN GROUP (ORDER BY i.method) AS methods
FROM {index} i JOIN {renames} r ON r.repo = i.repo AND r.method = i.method GROUP BY i.caller""",
)
HARD_DELETES = SqlOp(
    "Calls on repository variables that delete for good: a standard or derived delete whose first query, if any, starts with DELETE.",
    f"""
SELECT c.call_id, c.caller, c.callee FROM {{scoped}} c JOIN {{repos}} r ON r.name = c.scope_type
WHERE (c.callee IN ({", ".join(f"'{x}'" for x in DELETES)}) OR left(c.callee, 8) IN ('deleteBy', 'removeBy')) AND NOT EXISTS (
  SELECT 1 FROM {{queries}} q WHERE q.repo = c.scope_type AND q.method = c.callee AND q.first AND left(upper(q.query), 6) <> 'DELETE')""",
)
RENAMES = SqlOp(
    "Renames to take: changed, not reserved, mappable; of those to one name the first.",
    """
SELECT repo, old_name, new_name, seq FROM (
  SELECT *, row_number() OVER (PARTITION BY repo, new_name ORDER BY seq) AS n FROM {asked} a
  WHERE old_name <> new_name AND mappable AND NOT EXISTS (SELECT 1 FROM {reserved} r WHERE r.repo = a.repo AND r.name = a.new_name)
) x WHERE n = 1""",
)
LOGGER_ACTIONS = SqlOp(
    "What becomes of a logging call: printing goes; in a catch it is an error; in loops, controllers and lambdas it goes; else debug.",
    """
SELECT call_id, CASE WHEN is_print THEN 'REMOVE' WHEN in_catch THEN 'ERROR' WHEN in_loop OR in_controller OR in_lambda THEN 'REMOVE' ELSE 'DEBUG' END AS action
FROM {calls}""",
)


def base_type(text):
    """A type's name without generics and brackets."""
    return F.regexp_replace(F.regexp_replace(text, r"<.*>", ""), r"\[\]", "")


def type_matches(text, target):
    """Dotted targets match the whole name, others the last part."""
    base = base_type(text)
    return F.when(F.contains(target, F.lit(".")), base == target).otherwise(F.element_at(F.split(base, r"\."), -1) == target)


def type_contains(text, target):
    """Whether a part of the generic arguments is the target."""
    inner = F.regexp_extract(text, r"<(.*)>", 1)
    return F.exists(F.split(inner, r"[,<>]"), lambda p: F.trim(p) == target)


def parsed_signature(text):
    """(class, method) of ``Class#method(args)``."""
    return F.split_part(text, F.lit("#"), F.lit(1)), F.regexp_extract(text, r"#([^(]*)", 1)


def method_signature(cls, method, params):
    """Class#method(T1, T2)."""
    return F.concat(cls, F.lit("#"), method, F.lit("("), F.array_join(params, ", "), F.lit(")"))


def inherited_fields(own: DataFrame, extends: DataFrame) -> DataFrame:
    """(target, cls, field): field dependencies, those of every ancestor's too. extends(child, parent). Cycles end: seen rows are left out."""
    seen = front = cut(own.select("target", "cls", "field").distinct())
    while not front.isEmpty():
        down = front.join(extends, front.cls == extends.parent).select("target", F.col("child").alias("cls"), "field").distinct()
        front = cut(down.join(seen, ["target", "cls", "field"], "left_anti"))
        seen = seen.union(front)
    return seen


def position_mapping(old: str, new: str):
    """Old to new positions of parameters by name, as a map column; extra positions map to themselves; empty if the names differ."""
    o, n = F.col(old), F.col(new)
    pairs = F.transform(F.sequence(F.lit(0), F.size(o) - 1), lambda i: F.struct(i.alias("k"), (F.array_position(n, F.element_at(o, i + 1)) - 1).cast("int").alias("v")))
    same = (F.array_sort(o) == F.array_sort(n)) & (F.size(o) > 0)
    return F.when(same, F.map_from_entries(pairs)).otherwise(F.create_map().cast("map<int,int>"))


def reordered(args: str, new_order: str):
    """Arguments in a new order: an array of the old positions (from 0); those beyond it stay."""
    a, p = F.col(args), F.col(new_order)
    return F.transform(F.sequence(F.lit(1), F.size(a)), lambda i: F.element_at(a, F.when(i <= F.size(p), F.element_at(p, F.least(i, F.size(p))) + 1).otherwise(i)))


def early_change(old: str, new: str, k: int):
    """Whether one of the first ``k`` differs."""
    pairs = F.zip_with(F.slice(old, 1, k), F.slice(new, 1, k), lambda a, b: ~a.eqNullSafe(b))
    return F.exists(pairs, lambda x: x)
