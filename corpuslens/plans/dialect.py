"""Plans in SQL for Spark and DuckDB: one text, with the few places where the two differ as macros.

``{documents}`` is a table; ``{tok:documents,doc_id,text}`` its tokens as (id, pos, token);
``{words:...}`` its content words; ``{series:a,b}`` integers as i.
"""

from __future__ import annotations

import re

from corpuslens.functions.text import STOP_WORDS

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def render(sql: str, dialect: str, sf_dir: str = "") -> str:
    duck = dialect == "duckdb"

    def table(name: str) -> str:
        return name if duck else f"parquet.`{sf_dir}/{name}.parquet`"

    def lists(src: str, key: str, expr: str) -> str:
        src = table(src) if src in TABLES else src
        if duck:
            return f"(select {key}, unnest(l) token, cast(generate_subscripts(l, 1) - 1 as bigint) pos from (select {key}, {expr} l from {src}))"
        return f"(select {key}, token, cast(pos as bigint) pos from {src} lateral view posexplode({expr}) x as pos, token)"

    def macro(m: re.Match) -> str:
        name, _, rest = m[1].partition(":")
        args = [a.strip() for a in rest.split(",")] if rest else []
        if name in TABLES:
            return table(name)
        if name == "tok":
            return lists(args[0], args[1], f"regexp_extract_all(lower({args[2]}), '([a-z0-9]+)', 1)")
        if name == "words":
            stop = ", ".join(f"'{w}'" for w in STOP_WORDS)
            w = f"regexp_extract_all(lower({args[2]}), '([a-z][a-z0-9]+)', 1)"
            kept = f"list_filter({w}, lambda x: length(x) > 2 and x not in ({stop}))" if duck else f"filter({w}, x -> length(x) > 2 and x not in ({stop}))"
            return lists(args[0], args[1], kept)
        if name == "series":
            return f"(select unnest(generate_series({args[0]}, {args[1]})) i)" if duck else f"(select explode(sequence({args[0]}, {args[1]})) i)"
        if name == "grams":  # runs of args[1] signs of expression args[0]
            e, n = args
            return f"list_transform(generate_series(1, greatest(length({e}) - {n} + 1, 0)), lambda i: substring({e}, i, {n}))" if duck else f"case when length({e}) < {n} then array() else transform(sequence(1, length({e}) - {n} + 1), i -> substring({e}, i, {n})) end"
        if name == "sorted":  # the signs of a word in order
            return f"list_aggregate(list_sort(string_split({rest}, '')), 'string_agg', '')" if duck else f"array_join(array_sort(split({rest}, '')), '')"
        if name == "setkey":  # one text for a set of words
            return f"md5(string_agg(distinct {rest}, ' ' order by {rest}))" if duck else f"md5(array_join(array_sort(collect_set({rest})), ' '))"
        if name == "longest":  # texts of a column as alternatives of a pattern, longer ones first
            return f"string_agg({rest}, '|' order by length({rest}) desc, {rest})" if duck else f"array_join(transform(array_sort(collect_list(struct(-length({rest}) as n, {rest} as g))), x -> x.g), '|')"
        if name == "matches":  # what a pattern finds in a text, joined by spaces
            return f"array_to_string(regexp_extract_all({args[0]}, {args[1]}, 1), ' ')" if duck else f"array_join(regexp_extract_all({args[0]}, {args[1]}, 1), ' ')"
        if name == "json":  # a record of columns as JSON text
            pairs = ", ".join(f"'{a.split('.')[-1]}', {a}" for a in args)
            return f"cast(json_object({pairs}) as varchar)" if duck else f"to_json(named_struct({pairs}))"
        if name == "explode":
            return f"unnest({rest})" if duck else f"explode({rest})"
        if name == "micros":
            return f"epoch_us({rest})" if duck else f"unix_micros(cast({rest} as timestamp))"
        if name == "recursive":
            return "with recursive"
        raise KeyError(name)

    sql = re.sub(r"(?<![\w.'])(\d+\.\d+)(?![\w.])", r"\1e0", sql)  # doubles, not decimals
    inner = re.compile(r"\{([a-z]+(?::[^{}]*)?)\}")
    while inner.search(sql):  # a macro may hold others
        sql = inner.sub(macro, sql)
    return sql
