"""Registry of the engine's queries and their SQL counterparts."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from ..functions.keys import LabelKey, pads
from ..operators.ruleset import Pattern, RuleSet, default_patterns, make_rules, optional_patterns

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

# The public test key: 32 equal bytes.  Production keys come from storage.
TEST_KEY = b"\x09" * 32


def test_key() -> LabelKey:
    return LabelKey.public(TEST_KEY)


def query(name: str, sql: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return register


def quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def label_sql(value: str, category: str, key: bytes = TEST_KEY) -> str:
    return f"'[PII:' || {category} || ':' || substr({hmac_sql(value, key)}, 1, 16) || ']'"


def hmac_sql(value: str, key: bytes = TEST_KEY) -> str:
    inner, outer = pads(key)
    return (
        f"sha256(from_hex('{outer.hex()}') || from_hex(sha256(from_hex('{inner.hex()}') || encode({value}))))"
    )


# Rules used by most registered queries: every shipped pattern, a user-defined
# secret, and a literal that crosses it (to exercise clipping).
SECRET_HEX = Pattern("secret-hex", r'= "[0-9a-f]{40}"', "g", "secret", (("=", r'= "'),))
STD_PATTERNS = default_patterns() + [SECRET_HEX] + optional_patterns()
STD_LITERAL = 'token = "'
STD_RULES: RuleSet = make_rules(STD_PATTERNS, [STD_LITERAL])


@dataclass(frozen=True)
class Around:
    """A pattern with looks around it, for RE2: what may stand before, the match itself, what may follow."""

    before: str
    match: str
    after: str = ""


_OCTET = r"(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"
# First two octets of a public address: 0, 10, 127 and 255 are left out, as are
# 169.254, 192.168 and 172.16 to 172.31.
_PUBLIC = (
    r"(?:(?:25[0-4]|2[0-4]\d|1[013458]\d|12[0-689]|16[0-8]|17[013-9]|19[013-9]|[2-9]\d|1[1-9]|[1-9])\."
    + _OCTET
    + r"|169\.(?:25[0-35]|2[0-4]\d|1\d\d|[1-9]?\d)"
    r"|192\.(?:25[0-5]|2[0-4]\d|16[0-79]|1[0-57-9]\d|[1-9]?\d)"
    r"|172\.(?:25[0-5]|2[0-4]\d|1\d\d|[4-9]\d|3[2-9]|1[0-5]|\d))"
)
_HOST = r"(?:github|gitlab|bitbucket)\.(?:com|org)[/:]"
_SPACE = r"[ \t\n\x0b\f\r\x{a0}]"
AROUND = {
    "phone": Around(
        r"(?:^|[^\d.])",
        rf"(?:\+\d{{1,3}}[ .-]?)?(?:\(\d{{3}}\){_SPACE}?|\d{{3}}[ .-])\d{{3}}[ .-]\d{{4}}",
        r"(?:[^\d.]|$)",
    ),
    "git-org": Around(_HOST, "[A-Za-z0-9._-]+"),
    "git-repo": Around(_HOST + "[A-Za-z0-9._-]{1,64}/", "[A-Za-z0-9._-]+"),
    "ip": Around(r"(?:^|[^\d.])", rf"{_PUBLIC}\.{_OCTET}\.{_OCTET}", r"(?:[^\d.]|$)"),
    "ipv6": Around(
        r"(?:^|[^\w:])",
        r"(?:(?:[0-9a-f]{1,4}:){7}[0-9a-f]{1,4}|(?:[0-9a-f]{1,4}:){2,7}:(?:[0-9a-f]{1,4}(?::[0-9a-f]{1,4})*)?)",
        r"(?:[^\w:]|$)",
    ),
    "mac": Around(r"(?:^|[^\w:-])", r"(?:[0-9a-f]{2}[:-]){5}[0-9a-f]{2}", r"(?:[^\w:-]|$)"),
}
# The excluded numbers spelled out, since RE2 has no negative lookahead.
NO_LOOKS = {
    "us-ssn": r"\b(?:00[1-9]|0[1-9]\d|[1-5]\d\d|6[0-57-9]\d|66[0-57-9]|[78]\d\d)-(?:0[1-9]|[1-9]\d)-"
    r"(?:000[1-9]|00[1-9]\d|0[1-9]\d\d|[1-9]\d{3})\b",
}


def around_ctes(i: int, src: str, keys: str, text: str, flag: str, plain: list, special: list) -> str:
    """CTEs ending in ``d{i}(keys, category, s, e)``: matches in texts that hold a pattern with looks around it.

    ``plain`` and ``special`` hold ``(rank, name, regex or Around)``.  Every place
    where a special pattern matches is listed first; a recursion then takes, from
    the end of each match on, the earliest of the next special place and the next
    plain match, the lower rank first.
    """
    any_of = "|".join(f"(?:{a.before}{a.match}{a.after})" for _, _, a in special)
    places = " UNION ALL ".join(
        f"SELECT {keys}, p AS s, {rank} AS rank, {quoted(name)} AS name, "
        f"regexp_extract(substr({text}, p + 1), {quoted(f'{flag}^({a.match}){a.after}')}, 1) AS v FROM p{i} "
        f"WHERE regexp_matches(substr({text}, greatest(p - 79, 1), least(p, 80)), {quoted(f'{flag}{a.before}$')})"
        for rank, name, a in special
    )
    joined = "|".join(f"(?:{rx})" for _, _, rx in plain) or r"[^\s\S]"
    rank = "CASE " + " ".join(f"WHEN regexp_full_match(m.v, {quoted(flag + rx)}) THEN {r}" for r, _, rx in plain) + " END"
    name = "CASE rank " + " ".join(f"WHEN {r} THEN {quoted(n)}" for r, n, _ in plain + special) + " END"
    if not plain:
        rank = "NULL"
    first, later = (quoted(f"{flag}^{c}(?s:(.*?))({joined})") for c in ("", "(?s:.)"))
    step = (
        f"SELECT *, CASE WHEN pos = 0 THEN regexp_extract({text}, {first}, ['g', 'v']) "
        f"ELSE regexp_extract(substr({text}, pos), {later}, ['g', 'v']) END AS m, "
        "list_filter(places, lambda p: p.s >= pos)[1] AS x FROM walk"
    )
    both = (
        f"SELECT {keys}, {text}, places, CASE WHEN m.v <> '' THEN "
        f"{{'s': CAST(pos + len(m.g) AS BIGINT), 'rank': CAST({rank} AS INTEGER), 'e': CAST(pos + len(m.g) + len(m.v) AS BIGINT)}} END AS a, x FROM ({step})"
    )
    best = (
        "SELECT *, CASE WHEN a IS NULL THEN x WHEN x IS NULL THEN a WHEN x.s < a.s OR (x.s = a.s AND x.rank < a.rank) "
        f"THEN x ELSE a END AS hit FROM ({both})"
    )
    return (
        f"y{i} AS MATERIALIZED (SELECT {keys}, {text} FROM {src} WHERE regexp_matches({text}, {quoted(flag + any_of)})), "
        f"p{i} AS (SELECT *, unnest(range(0, len({text}))) AS p FROM y{i}), "
        f"x{i} AS (SELECT {keys}, list({{'s': CAST(s AS BIGINT), 'rank': CAST(rank AS INTEGER), 'e': CAST(s + len(v) AS BIGINT)}} "
        f"ORDER BY s, rank) AS places FROM ({places}) WHERE v <> '' GROUP BY {keys}), "
        f"d{i} AS (WITH RECURSIVE walk AS (SELECT {keys}, {text}, places, CAST(0 AS BIGINT) AS pos, CAST(NULL AS BIGINT) AS s, "
        f"CAST(NULL AS INTEGER) AS rank FROM y{i} JOIN x{i} USING ({keys}) UNION ALL "
        f"SELECT {keys}, {text}, places, hit.e, hit.s, hit.rank FROM ({best}) WHERE hit IS NOT NULL) "
        f"SELECT {keys}, {name} AS category, s, pos AS e FROM walk WHERE s IS NOT NULL)"
    )


def span_ctes(src: str, keys: str, text: str = "text", rules: RuleSet = STD_RULES, more: str | None = None) -> str:
    """DuckDB CTEs ending in ``spans(keys, s, e, category, value)``.

    Written independently of the column expressions: matches and gaps are
    unnested, offsets come from running sums, conflicts from a running maximum.
    ``more`` names a relation of further candidates ``(keys, category, s, e)``.
    """
    buckets: list[tuple[str, list[tuple[str, str]], str, list, list]] = []
    for ci in dict.fromkeys(p.insensitive for p in rules.patterns):
        flag = "(?i)" if ci else ""
        ranked = list(enumerate(p for p in rules.patterns if p.insensitive is ci))
        special = [(r, p.name, AROUND[p.name]) for r, p in ranked if p.name in AROUND]
        plain = [(r, p.name, NO_LOOKS.get(p.name, p.regex)) for r, p in ranked if p.name not in AROUND]
        joined = flag + ("|".join(f"(?:{rx})" for _, _, rx in plain) or r"[^\s\S]")
        buckets.append((joined, [(n, flag + rx) for _, n, rx in plain], flag, plain, special))
    for lit in rules.literals:
        if lit.boundary:
            raise ValueError("guarded literals need lookaround")
        source = "(?i)" + "".join("\\" + c if c in r".*+?^${}()|[]\\" else c for c in lit.value)
        buckets.append((source, [("personal", source)], "(?i)", [], []))
    out, cands = [], []
    for i, (regex, parts, flag, plain, special) in enumerate(buckets):
        rest = src
        if special:
            out.append(around_ctes(i, src, keys, text, flag, plain, special))
            cands.append(f"SELECT {keys}, {i} AS o, category, s, e FROM d{i}")
            rest = f"(SELECT * FROM {src} ANTI JOIN y{i} USING ({keys}))"
        case = "CASE " + " ".join(
            f"WHEN regexp_full_match(v, {quoted(rx)}) THEN {quoted(n)}" for n, rx in parts
        ) + " END" if parts else "NULL"
        rx = quoted(regex)
        out.append(
            f"m{i} AS (SELECT {keys}, regexp_extract_all({text}, {rx}) AS ms, "
            f"string_split_regex({text}, {rx}) AS gs FROM {rest}), "
            f"u{i} AS (SELECT {keys}, unnest(range(1, len(ms) + 1)) AS mi, unnest(ms) AS v, "
            f"unnest(gs[1:len(ms)]) AS g FROM m{i} WHERE len(ms) > 0), "
            f"c{i} AS (SELECT {keys}, {i} AS o, {case} AS category, "
            f"sum(len(g)) OVER w + sum(len(v)) OVER w - len(v) AS s, "
            f"sum(len(g)) OVER w + sum(len(v)) OVER w AS e "
            f"FROM u{i} WINDOW w AS (PARTITION BY {keys} ORDER BY mi))"
        )
        cands.append(f"SELECT {keys}, o, category, s, e FROM c{i}")
    if more:
        cands.append(f"SELECT {keys}, {len(buckets)} AS o, category, s, e FROM {more}")
    out.append("cand AS (" + " UNION ALL ".join(cands) + ")")
    out.append(
        f"res AS (SELECT *, coalesce(max(e) OVER (PARTITION BY {keys} ORDER BY s, e DESC, o "
        "ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS cur FROM cand)"
    )
    on = " AND ".join(f"r.{k.strip()} = d.{k.strip()}" for k in keys.split(","))
    cols = ", ".join(f"r.{k.strip()}" for k in keys.split(","))
    out.append(
        f"spans AS (SELECT {cols}, CAST(greatest(s, cur) AS BIGINT) AS s, CAST(e AS BIGINT) AS e, category, "
        f"substr(d.{text}, CAST(greatest(s, cur) + 1 AS BIGINT), CAST(e - greatest(s, cur) AS BIGINT)) AS value "
        f"FROM res r JOIN {src} d ON {on} WHERE e > cur)"
    )
    return ", ".join(out)


def redacted_ctes(src: str, keys: str, text: str = "text", rules: RuleSet = STD_RULES, more: str | None = None) -> str:
    """``span_ctes`` plus ``redacted(keys, text, out)`` over every unit."""
    cols = ", ".join(f"d.{k.strip()}" for k in keys.split(","))
    on = " AND ".join(f"p.{k.strip()} = d.{k.strip()}" for k in keys.split(","))
    return (
        span_ctes(src, keys, text, rules, more)
        + f", placed AS (SELECT s.*, lag(e, 1, 0) OVER (PARTITION BY {keys} ORDER BY s) AS prev FROM spans s)"
        + f", built AS (SELECT {cols}, string_agg(substr(d.{text}, CAST(prev + 1 AS BIGINT), CAST(s - prev AS BIGINT)) || "
        + label_sql("p.value", "p.category")
        + f", '' ORDER BY s) AS head, max(e) AS last FROM placed p JOIN {src} d ON {on} GROUP BY {cols})"
        + f", redacted AS (SELECT {cols}, d.{text} AS text, CASE WHEN p.last IS NULL THEN d.{text} "
        + f"ELSE p.head || substr(d.{text}, CAST(p.last + 1 AS BIGINT)) END AS out FROM {src} d LEFT JOIN built p ON {on})"
    )
