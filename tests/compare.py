"""Compare a Spark result with the result of its SQL twin, values and types."""

import math

KINDS = {
    "tinyint": "int", "smallint": "int", "int": "int", "bigint": "int", "double": "double", "string": "text",
    "boolean": "bool", "TINYINT": "int", "INTEGER": "int", "BIGINT": "int", "DOUBLE": "double", "VARCHAR": "text",
    "BOOLEAN": "bool",
}


def _key(row):
    return tuple((v is None, str(type(v)), 0 if v is None else v) for v in row)


def _clean(value):
    return "nan" if isinstance(value, float) and math.isnan(value) else value


def differences(df, connection, sql):
    cursor = connection.execute(sql)
    names = [c[0] for c in cursor.description]
    kinds = {c[0]: KINDS.get(str(c[1]), str(c[1])) for c in cursor.description}
    expected = cursor.fetchall()
    if sorted(df.columns) != sorted(names):
        return f"columns {sorted(df.columns)} and {sorted(names)}"
    for field in df.schema:
        kind = KINDS.get(field.dataType.simpleString(), field.dataType.simpleString())
        if kind != kinds[field.name]:
            return f"type of {field.name}: {kind} and {kinds[field.name]}"
    order = sorted(names)
    ours = sorted(([_clean(r[c]) for c in order] for r in df.collect()), key=_key)
    theirs = sorted(([_clean(r[names.index(c)]) for c in order] for r in expected), key=_key)
    if len(ours) != len(theirs):
        return f"{len(ours)} and {len(theirs)} rows"
    for a, b in zip(ours, theirs):
        if a != b:
            return f"{order}: {a} and {b}"
    return None
