"""SQL fragments shared by the SQL twins."""

from lodestone.functions.text import ENDINGS, STOP_WORDS, WHITE

STOP = "[" + ", ".join(f"'{w}'" for w in STOP_WORDS) + "]"


def strip(e: str) -> str:
    return f"trim({e}, '{WHITE}')"


def squeeze(e: str) -> str:
    return strip(f"regexp_replace({e}, '\\s+', ' ', 'g')")


def stem(w: str) -> str:
    return (
        f"CASE WHEN length({w}) < 5 OR regexp_matches({w}, '[_\\p{{Nd}}]') OR {w} = 'нельзя' THEN {w} "
        f"ELSE regexp_replace({w}, '(?:{'|'.join(ENDINGS)})$', '') END"
    )


def search_tokens(e: str) -> str:
    runs = f"regexp_extract_all(replace(lower({e}), 'ё', 'е'), '[\\p{{L}}\\p{{N}}_№.+\\-]+')"
    words = f"list_transform({runs}, lambda w: regexp_replace(w, '^[.\\-]+|[.\\-]+$', '', 'g'))"
    kept = f"list_filter({words}, lambda w: w <> '' AND NOT list_contains({STOP}, w))"
    return f"list_transform({kept}, lambda w: {stem('w')})"


def retrieval_tokens(e: str) -> str:
    joined = f"regexp_extract_all({e}, '[\\p{{L}}\\p{{N}}]+(?:_[\\p{{L}}\\p{{N}}]+)+')"
    parts = f"list_filter(flatten(list_transform({joined}, lambda w: string_split(w, '_'))), lambda w: length(w) > 2)"
    inner = f"flatten(list_transform({parts}, lambda p: {search_tokens('p')}))"
    return f"list_concat({search_tokens(e)}, {inner})"


def token_count(e: str) -> str:
    return f"CAST(len(regexp_extract_all({e}, '[\\p{{L}}\\p{{N}}_]+|[^\\s\\p{{L}}\\p{{N}}_]')) AS INTEGER)"
