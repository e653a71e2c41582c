"""DuckDB fragments for the oracles. Written independently of the Spark expressions (different regex dialect)."""

from __future__ import annotations

from catalake.functions import vocabulary as v

WS = r"[\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"


def strip(x: str) -> str:
    return f"regexp_replace(coalesce({x}, ''), '^{WS}+|{WS}+$', '', 'g')"


def collapse(x: str) -> str:
    return f"trim(regexp_replace(coalesce({x}, ''), '{WS}+', ' ', 'g'))"


def squash(x: str) -> str:
    return f"lower({collapse(x)})"


def number(x: str) -> str:
    return f"CASE WHEN regexp_full_match({x}, '[+-]?[0-9](_?[0-9])*') THEN CAST(replace({x}, '_', '') AS BIGINT) END"


def text_list(values) -> str:
    return "(" + ", ".join("'" + value.replace("'", "''") + "'" for value in values) + ")"


def rows_of(table: dict[str, str] | list[tuple], columns: str) -> str:
    items = table.items() if isinstance(table, dict) else table
    body = ", ".join(
        "(" + ", ".join(str(x) if isinstance(x, int) else "'" + x.replace("'", "''") + "'" for x in item) + ")"
        for item in items
    )
    return f"SELECT * FROM (VALUES {body}) AS t({columns})"


def alias_key(x: str) -> str:
    return rf"lower(regexp_replace({x}, '[ \t\n\r\v\f_-]', '', 'g'))"


def alias_rows(table: dict[str, str]) -> str:
    return f"SELECT DISTINCT {alias_key('spelling')} AS alias, standard FROM ({rows_of(table, 'spelling, standard')})"


def category_rows() -> str:
    return rows_of(v.CATEGORY_ALIASES, "alias, category")


def keyword_rows() -> str:
    items = [
        (category, word, place)
        for place, (category, word) in enumerate(
            (category, word) for category, words in v.CATEGORY_KEYWORDS.items() for word in words
        )
    ]
    return rows_of(items, "category, keyword, place")


def term_rows(terms) -> str:
    return rows_of([(term, place) for place, term in enumerate(terms)], "term, place")
