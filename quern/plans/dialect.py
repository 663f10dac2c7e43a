"""One SQL text for Spark and for DuckDB: tables in braces, and a few function names that differ."""

from __future__ import annotations

import re
from collections.abc import Callable

from quern.session import table

SPARK = {
    "half_even": "bround", "list": "collect_list", "sort": "sort_array", "mid": "(size({0}) div 2)", "json_int": "cast(get_json_object({0}, '$.{1}') as bigint)",
    "at0": "{0}[cast({1} as int)]", "lam": "{0} ->", "map": "transform", "keep": "filter", "len": "size", "true_div": "{0} / {1}",
}
DUCK = {
    "half_even": "round_even", "list": "list", "sort": "list_sort", "mid": "(len({0}) // 2)", "json_int": "cast(json_extract({0}, '$.{1}') as bigint)",
    "at0": "{0}[cast({1} as int) + 1]", "lam": "lambda {0}:", "map": "list_transform", "keep": "list_filter", "len": "len", "true_div": "{0} / {1}",
}
_TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def _render(sql: str, names: dict[str, str]) -> str:
    """#name(args|args) becomes the dialect's form; arguments hold no parentheses of their own but through nested marks."""
    pattern = re.compile(r"#(\w+)\(([^()|]*(?:\([^()]*\)[^()|]*)*)(?:\|([^()]*(?:\([^()]*\)[^()]*)*))?\)")
    while True:
        m = pattern.search(sql)
        if not m:
            return re.sub(r"#(\w+)", lambda x: names.get(x[1], x[0]), sql)
        form = names[m[1]]
        args = [a for a in (m[2], m[3]) if a is not None]
        sql = sql[: m.start()] + (form.format(*args) if "{0}" in form else f"{form}({m[2]})") + sql[m.end() :]


def both(name: str, sql: str, **given) -> tuple[str, Callable, str]:
    """name, the Spark query and the DuckDB text."""

    def query(spark, sf_dir):
        text = _render(sql, SPARK)
        used = {t: table(spark, sf_dir, t) for t in _TABLES if re.search(rf"\b{t}\b", text)}
        for t, df in used.items():
            df.createOrReplaceTempView(t)
        return spark.sql(text)

    query.__name__ = name
    query.__doc__ = f"{name}, in SQL."
    return name, query, _render(sql, DUCK)
