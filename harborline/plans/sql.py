"""Pieces of DuckDB SQL that several queries' counterparts share."""
SPACE = r"[\s\x{00A0}\x{2000}-\x{200A}\x{202F}\x{3000}\x{FEFF}]+"


def quote(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


def flat(x: str) -> str:
    """White space collapsed and cut at both ends."""
    return f"trim(regexp_replace({x}, '{SPACE}', ' ', 'g'))"


def plain(x: str) -> str:
    """Lower-case words and numbers with one space before, between and behind them."""
    return rf"(' ' || trim(regexp_replace(lower(coalesce({x}, '')), '[^\p{{L}}\p{{N}}]+', ' ', 'g')) || ' ')"


def has_phrase(words: str, phrases) -> str:
    return "(" + " OR ".join(f"contains({words}, {quote(f' {p} ')})" for p in phrases) + ")"
