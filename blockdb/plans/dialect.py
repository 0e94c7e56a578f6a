"""One SQL text, two engines: views by name in braces, and the few functions whose names differ."""

from __future__ import annotations

import re
from collections.abc import Callable


def _calls(sql: str, name: str, make: Callable[[str], str]) -> str:
    """Replace each call of `name`, its arguments given as text."""
    out, at = "", 0
    for m in re.finditer(rf"\b{name}\(", sql):
        if m.start() < at:
            continue
        depth, end = 1, m.end()
        while depth:
            depth += {"(": 1, ")": -1}.get(sql[end], 0)
            end += 1
        out += sql[at : m.start()] + make(_calls(sql[m.end() : end - 1], name, make))
        at = end
    return out + sql[at:]


def duckdb(sql: str) -> str:
    """The text for DuckDB."""
    sql = re.sub(r"\{(\w+)\}", r"\1", sql)
    sql = _calls(sql, "bit_xor_", lambda a: f"xor({a})")
    sql = _calls(sql, "sha2", lambda a: f"sha256({a.rpartition(',')[0]})")
    sql = _calls(sql, "explode", lambda a: f"unnest({a})")
    sql = _calls(sql, "sequence", lambda a: f"generate_series({a})")
    sql = _calls(sql, "timestampdiff", lambda a: f"epoch_us({a.rpartition(',')[2].strip()})")  # microseconds since 1970
    sql = _calls(sql, "get_json_object", lambda a: f"json_extract_string({a})")
    sql = _calls(sql, "bround", lambda a: f"round_even({a}, 0)")
    sql = _calls(sql, "array", lambda a: f"[{a}]")
    sql = _calls(sql, "size", lambda a: f"len({a})")
    sql = _calls(sql, "shiftleft", lambda a: "(({}) << ({}))".format(*(x.strip() for x in a.rsplit(",", 1))))
    sql = _calls(sql, "shiftright", lambda a: "(({}) >> ({}))".format(*(x.strip() for x in a.rsplit(",", 1))))
    return re.sub(r"\bdiv\b", "//", sql)


def spark(sql: str) -> str:
    """The text for Spark, which writes an exclusive or as an operator."""
    return _calls(sql, "bit_xor_", lambda a: "(({}) ^ ({}))".format(*(x.strip() for x in a.split(",", 1))))


def join_ctes(ctes: list[str], sql: str) -> str:
    """Put `ctes` before a query that may have its own."""
    if not ctes:
        return sql
    sql = sql.strip()
    if head := re.match(r"with(\s+recursive)?\b", sql, re.I):
        return head[0] + " " + ",\n".join(ctes) + ",\n" + sql[head.end() :].lstrip()
    return "with " + ",\n".join(ctes) + "\n" + sql
