"""URL filters by a bit-parallel wildcard automaton.

All glob rules are laid out one behind the other as bits of multiword masks
(Shift-And). One step per byte advances every rule at once: shift by one with a
carry between words, keep the bits whose glob position accepts the byte, and let
wildcard positions keep themselves. A batch of URLs is advanced together, so a
step is a few array operations.

Domain rules read host and path as the URL has them. Globs read the canonical form:
without user name, port and trailing dots, escapes of unreserved characters decoded,
dot segments resolved. ``*`` in a glob's host part matches any bytes but ``/``, in its
path part any bytes.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tarnfield.llm.text import ASCII_LOWER, as_bytes


@dataclass(frozen=True)
class Rule:
    """``name`` is what is reported; ``globs`` are (host glob, path glob) pairs."""

    name: str
    verdict: str
    globs: tuple[tuple[str, str], ...]
    fixed: bool = True


def domain_rule(verdict: str, host: str, path: str) -> Rule:
    """A rule for a host and all its subdomains, by prefix of the path."""
    return Rule(host + path, verdict, ((host, path + "*"), ("*." + host, path + "*")))


# The rules that every verdict begins with, longest first to win.
DOMAIN_RULES = (
    domain_rule("allow", "org", "/"),
    domain_rule("block", "example.org", "/es/"),
    domain_rule("block", "example.org", "/en/1"),
    domain_rule("allow", "com", "/fr/"),
    domain_rule("block", "com", "/de/"),
)
# Words of adult and gambling hosts, prefixes of advertising hosts, first
# path segments and inner ones of pages without prose, and endings of files that are none.
HOST_WORDS = ("casino", "porn", "xxx", "betting", "poker", "jackpot", "escort", "hentai", "sexcam", "sexchat", "adultchat", "nudes", "camgirl", "onlyslots", "roulette", "bookmaker")
AD_HOSTS = ("ads", "ad", "adserver", "adservice", "banner", "banners", "tracking", "tracker", "pixel", "beacon", "doubleclick")
FIRST_SEGMENTS = ("login", "logout", "signin", "signup", "register", "cart", "checkout", "basket", "wishlist", "cgi-bin", "xmlrpc.php")
INNER_SEGMENTS = ("wp-admin", "wp-login.php", "wp-json", "oauth", "phpmyadmin", "ajax")
ENDINGS = ("jpg", "jpeg", "png", "gif", "bmp", "ico", "svg", "webp", "tiff", "zip", "gz", "bz2", "xz", "7z", "rar", "tar", "tgz", "iso", "dmg", "exe", "msi", "apk", "deb", "rpm", "jar", "bin", "dll", "mp3", "mp4", "avi", "mov", "mkv", "wav", "flac", "ogg", "webm", "woff", "woff2", "ttf", "css", "js")


def glob_rule(host: str, path: str, verdict: str = "block") -> Rule:
    return Rule(f"{host}{path}", verdict, ((host, path),), fixed=False)


#: What is blocked where no domain rule fits, in order.
GLOB_RULES = (
    *(glob_rule(f"*{w}*", "*") for w in HOST_WORDS),
    *(glob_rule(h, "*") for w in AD_HOSTS for h in (f"{w}.*", f"*.{w}.*")),
    *(glob_rule("*", p) for w in FIRST_SEGMENTS for p in (f"/{w}", f"/{w}/*")),
    *(glob_rule("*", p) for w in INNER_SEGMENTS for p in (f"*/{w}", f"*/{w}/*")),
    *(glob_rule("*", f"*.{w}") for w in ENDINGS),
)
#: Characters whose escapes mean nothing else.
UNRESERVED = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789-._~"
_ESCAPE = re.compile(rb"%([0-9A-Fa-f]{2})")
DEFAULT_VERDICT = "allow"


class WildcardAutomaton:
    """Shift-And over all globs. A glob's literal bytes take a bit each; a ``*``
    sets the bit before it to keep itself (``stay``). A bit of its own in front of
    each glob stands for "nothing read yet"."""

    def __init__(self, globs: list[tuple[str, str]]) -> None:
        accept: list[set[int]] = []  # bytes that lead into the bit
        stay: list[set[int]] = []  # bytes on which the bit keeps itself
        self.begin, self.end = [], []
        for host, path in globs:
            self.begin.append(len(accept))
            accept.append(set())
            stay.append(set())
            for part, wild in ((host, set(range(256)) - {ord("/")}), (path, set(range(256)))):
                for byte in part.encode():
                    if byte == ord("*"):
                        stay[-1] |= wild
                    else:
                        accept.append({byte})
                        stay.append(set())
            self.end.append(len(accept) - 1)
        self.words = (len(accept) + 63) // 64
        self.into, self.keep = (np.zeros((256, self.words), np.uint64) for _ in range(2))
        for table, sets in ((self.into, accept), (self.keep, stay)):
            for bit, bytes_ in enumerate(sets):
                for byte in bytes_:
                    table[byte, bit >> 6] |= np.uint64(1 << (bit & 63))
        self.start = np.zeros(self.words, np.uint64)
        for bit in self.begin:
            self.start[bit >> 6] |= np.uint64(1 << (bit & 63))

    def match(self, texts: list[bytes]) -> np.ndarray:
        """Which glob matches which whole text: booleans, texts by globs."""
        n = len(texts)
        lengths = np.array([len(t) for t in texts], np.int64)
        order = np.argsort(-lengths, kind="stable")  # those still running come first
        state = np.tile(self.start, (n, 1))
        flat = np.frombuffer(b"".join(texts[i] for i in order), np.uint8)
        sorted_len = lengths[order]
        starts = np.concatenate(([0], np.cumsum(sorted_len)))[:-1]
        top = np.uint64(63)
        running, step = n, 0
        while running:
            running = int(np.searchsorted(-sorted_len[:running], -step, side="left"))
            if not running:
                break
            byte = flat[starts[:running] + step]
            s = state[:running]
            moved = s << np.uint64(1)
            moved[:, 1:] |= s[:, :-1] >> top
            state[:running] = (moved & self.into[byte]) | (s & self.keep[byte])
            step += 1
        found = np.zeros((n, len(self.end)), bool)
        for k, bit in enumerate(self.end):
            found[order, k] = (state[:, bit >> 6] >> np.uint64(bit & 63)) & np.uint64(1) != 0
        return found


def split_url(raw: bytes | None) -> tuple[bytes, bytes]:
    """Host and path; both empty for null or where ``://`` is missing."""
    _, mark, rest = (raw or b"").partition(b"://")
    if not mark:
        return b"", b""
    for stop in (b"#", b"?"):
        rest = rest.partition(stop)[0]
    host, slash, path = rest.partition(b"/")
    return host.translate(ASCII_LOWER), slash + path


def rules_of(table: DataFrame) -> tuple[Rule, ...]:
    """Glob rules of a table (host, path, verdict), by host and path: the rules are a
    parameter that every executor holds, so the table must be one that fits there."""
    rows = table.select("host", "path", "verdict").orderBy("host", "path", "verdict").collect()
    return tuple(glob_rule(r["host"], r["path"], r["verdict"]) for r in rows)


def canonical(host: bytes, path: bytes) -> bytes:
    """Host without user name, port and trailing dots, and the path with plain escapes
    decoded and dot segments resolved."""
    host = host.rpartition(b"@")[2]
    name, colon, port = host.rpartition(b":")
    if colon and not port.strip(b"0123456789"):
        host = name
    host = host.rstrip(b".")
    if b"%" in path:
        path = _ESCAPE.sub(lambda m: bytes([int(m[1], 16)]) if chr(int(m[1], 16)) in UNRESERVED else m[0], path)
    if b"/." in path:
        out: list[bytes] = []
        segments = path.split(b"/")[1:]
        for x in segments:
            if x == b"..":
                del out[-1:]
            elif x != b".":
                out.append(x)
        path = b"".join(b"/" + x for x in out) + (b"/" if segments[-1] in (b".", b"..") else b"")
    return host + path


def judge(urls: list[bytes | None], rules: tuple[Rule, ...], automaton: WildcardAutomaton) -> list[tuple]:
    """(host, path, rule, verdict, glob rule) of each url. The longest fixed rule
    that fits wins (of equal lengths the first listed), then the first glob rule.
    One automaton serves both; globs see the canonical form, fixed rules the plain one."""
    owner = [k for k, r in enumerate(rules) for _ in r.globs]
    rank = sorted(range(len(rules)), key=lambda k: (not rules[k].fixed, -len(rules[k].name) if rules[k].fixed else 0, k))
    parts = [split_url(u) for u in urls]
    distinct = list(dict.fromkeys(parts))
    plain = [h + p for h, p in distinct]
    clean = [canonical(h, p) for h, p in distinct]
    forms = list(dict.fromkeys([*plain, *clean]))
    hits, at = automaton.match(forms), {f: k for k, f in enumerate(forms)}
    own, other = hits[[at[f] for f in plain]], hits[[at[f] for f in clean]]
    fits = np.zeros((len(distinct), len(rules) + 1), bool)
    for g, k in enumerate(owner):
        fits[:, k] |= own[:, g] if rules[k].fixed else other[:, g]
    fits[:, -1] = True
    winner = dict(zip(distinct, np.array([*rank, len(rules)])[np.argmax(fits[:, [*rank, len(rules)]], axis=1)].tolist()))
    out = []
    for host, path in parts:
        k = winner[host, path]
        rule = rules[k] if k < len(rules) else None
        fixed = rule is not None and rule.fixed
        out.append((host, path, rule.name if fixed else None, rule.verdict if rule else DEFAULT_VERDICT, rule.name if rule and not fixed else None))
    return out


def filter_urls(pages: DataFrame, domain_rules: tuple[Rule, ...] = DOMAIN_RULES, glob_rules: tuple[Rule, ...] = GLOB_RULES, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """One row per page: id, host, path, rule, verdict, glob_rule.

    ``rule`` is the domain rule that decided, ``glob_rule`` the glob rule that did
    where no domain rule fits; with neither the verdict is DEFAULT_VERDICT. Null
    urls and urls without ``://`` have empty host and path and fit no domain rule.
    Repeated rows are judged each; an empty table gives an empty result; only the url
    column is read, whatever the names of others; no shuffle. A very long url costs a
    step for each of its bytes.
    """
    rules = (*domain_rules, *glob_rules)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = WildcardAutomaton([g for r in rules for g in r.globs])
        for batch in batches:
            host, path, rule, verdict, glob = list(zip(*judge(as_bytes(batch.column(1)), rules, automaton))) or [()] * 5
            text = [pa.array(x, pa.binary()).cast(pa.string()) for x in (host, path)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *text, *(pa.array(x, pa.string()) for x in (rule, verdict, glob))], names=[id_col, "host", "path", "rule", "verdict", "glob_rule"])

    kind = pages.schema[id_col].dataType.simpleString()
    return pages.select(id_col, url_col).mapInArrow(run, f"`{id_col}` {kind}, host string, path string, rule string, verdict string, glob_rule string")


def op5_url_filters(spark, sf_dir: str) -> DataFrame:
    return filter_urls(spark.read.parquet(f"{sf_dir}/pages.parquet"))


def _fits_sql(rule: Rule) -> str:
    host, path = rule.globs[0][0], rule.globs[0][1][:-1]
    return f"((host = '{host}' OR ends_with(host, '.{host}')) AND starts_with(path, '{path}'))"


def oracle_sql() -> str:
    base = sorted(DOMAIN_RULES, key=lambda r: -len(r.name))
    # an empty host and path can meet only globs that are all stars
    globs = []
    decoded = "list_reduce(list_prepend(path, [" + ", ".join(f"'{x}'" for x in dict.fromkeys(f for c in UNRESERVED for f in (f"%{ord(c):02X}", f"%{ord(c):02x}"))) + "]), lambda a, x: replace(a, x, chr(('0x' || substr(x, 2))::INT)))"
    for r in GLOB_RULES:
        h, p = r.globs[0]
        pattern = "".join("[^/]*" if c == "*" else c.replace(".", "[.]") for c in h) + "".join("(.|\\n)*" if c == "*" else c.replace(".", "[.]") for c in p)
        globs.append(f"WHEN regexp_full_match(clean, '{pattern}') THEN '{r.name}'")
    rule = "CASE " + " ".join(f"WHEN {_fits_sql(r)} THEN '{r.name}'" for r in base) + " END"
    verdict = "CASE " + " ".join(f"WHEN rule = '{r.name}' THEN '{r.verdict}'" for r in base) + f" WHEN glob_rule IS NOT NULL THEN 'block' ELSE '{DEFAULT_VERDICT}' END"
    return f"""
WITH rest AS (SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS r FROM pages),
cut AS (SELECT page_id, r, regexp_extract(r, '^[^/?#]*') AS raw_host FROM rest),
parts AS (SELECT page_id, translate(raw_host, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
  CASE WHEN substr(r, length(raw_host) + 1, 1) = '/' THEN regexp_extract(substr(r, length(raw_host) + 1), '^[^?#]*') ELSE '' END AS path FROM cut),
ruled AS (SELECT page_id, host, path, {rule} AS rule FROM parts),
plain AS (SELECT *, {decoded} AS p, regexp_replace(regexp_replace(regexp_replace(host, '^(.|\\n)*@', ''), ':[0-9]*$', ''), '[.]+$', '') AS h FROM ruled),
segments AS (SELECT *, str_split(p, '/')[2:] AS s FROM plain),
resolved AS (SELECT *, h || CASE WHEN contains(p, '/.') THEN list_reduce(list_prepend('', s), lambda a, x: CASE x WHEN '.' THEN a WHEN '..' THEN regexp_replace(a, '/[^/]*$', '') ELSE a || '/' || x END)
  || CASE WHEN s[-1] IN ('.', '..') THEN '/' ELSE '' END ELSE p END AS clean FROM segments),
globbed AS (SELECT *, CASE WHEN rule IS NULL THEN CASE {' '.join(globs)} END END AS glob_rule FROM resolved)
SELECT page_id, host, path, rule, {verdict} AS verdict, glob_rule FROM globbed"""
