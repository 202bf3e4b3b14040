"""Target schemas from JSON files, checked as a whole, as rows of the field list."""

from __future__ import annotations

import json
import re

from pyspark.sql import DataFrame, SparkSession

from intakeforge.operators.casting import SPARK_TYPES

FIELDS = "schema_name string, field_name string, field_type string, is_required boolean, unit string, aliases array<string>, allowed_values array<string>, value_pattern string, is_key boolean, synonyms map<string,string>"


class SchemaError(ValueError):
    """A schema that cannot be used: all that is wrong with it is in the message."""


def parse_schema(text: str) -> list[tuple]:
    """Rows of `FIELDS` of one schema: ``{"name", "key": [...], "synonyms": {...}, "fields": [{"name", "type", ...}]}``."""
    try:
        s = json.loads(text)
    except ValueError as e:
        raise SchemaError(f"no JSON: {e}") from e
    if not isinstance(s, dict) or not isinstance(s.get("fields"), list) or not s.get("name"):
        raise SchemaError("a schema has a name and a list of fields")
    names = [f.get("name") for f in s["fields"] if isinstance(f, dict)]
    wrong = [f"a field has no name: {f}" for f in s["fields"] if not isinstance(f, dict) or not re.fullmatch("[a-z][a-z0-9_]*", str(f.get("name") or ""))]
    wrong += [f"{n} occurs twice" for n in sorted({n for n in names if n and names.count(n) > 1})]
    wrong += [f"{f['name']} has the unknown type {f.get('type')}" for f in s["fields"] if isinstance(f, dict) and f.get("name") and f.get("type", "string") not in SPARK_TYPES]
    wrong += [f"key field {k} is not there" for k in s.get("key") or [] if k not in names]
    wrong += [] if s.get("key") else ["a schema needs a key"]
    for f in s["fields"]:
        try:
            re.compile((f.get("pattern") if isinstance(f, dict) else None) or "")
        except re.error as e:
            wrong.append(f"{f.get('name')} has a broken pattern: {e}")
    if wrong:
        raise SchemaError("; ".join(wrong))
    return [(s["name"], f["name"], f.get("type", "string"), bool(f.get("required")), f.get("unit"), list(f.get("aliases") or []), list(f["allowed"]) if f.get("allowed") else None, f.get("pattern"), f["name"] in s["key"], s.get("synonyms")) for f in s["fields"]]


def read_schemas(spark: SparkSession, path: str) -> DataFrame:
    """The fields of every schema file under ``path``; a few small files, which the driver reads."""
    files = spark.read.text(path, wholetext=True).toLocalIterator()
    return spark.createDataFrame([row for f in files for row in parse_schema(f[0])], FIELDS)
