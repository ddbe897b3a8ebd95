"""URL filters: all wildcard rules at once as one bit-parallel automaton.

Every glob becomes a start bit and one bit per symbol; a ``*`` is a self-loop of the bit before it.
The rules' bits lie side by side in a row of 64-bit words, with carries between words, so one
Shift-And step moves every rule over one character. Steps are vectorised over all URLs of a batch.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common, textvec

Rule = tuple[int, str, str]

_HOSTS = "doubleclick.net googlesyndication.com adnxs.com taboola.com outbrain.com scorecardresearch.com criteo.com".split()
_FILES = "zip exe dmg iso apk msi rar 7z tar.gz mp4 avi mov mp3 wav flac jpg jpeg png gif svg webp ico css js woff2 ttf pdf".split()
_WORDS = "login signin signup register cart checkout account password reset admin wp-admin wp-login.php cgi-bin unsubscribe".split()
_SPAM = "casino poker viagra payday-loan torrent warez xxx escort replica-watch free-download crack keygen".split()
_ODD = ["*sessionid=*", "*PHPSESSID=*", "*?*?*", "*[[]*", "*%00*", "*//*//*//*", "ftp:*", "mailto:*", "javascript:*", "data:*", "*://localhost*", "*://127.0.0.?/*", "*://10.*.*.*/*", "*://192.168.*", "*@*:*@*"]
_SITE = [
    ("deny", "*://m.*"), ("deny", "*://*/amp/*"), ("deny", "*?page=*"), ("deny", "*&page=*"), ("deny", "*/tag/*"),
    ("deny", "*/feed/"), ("deny", "*/print/*"), ("deny", "http://*.example.org/??/*0"), ("deny", "*://blog.*.example.com/*"),
    ("deny", "*://*.example.net/es/*"), ("deny", "*://*.example.???/de/?"), ("deny", "*://*.example.???/de/??"),
    ("allow", "https://*.example.com/en/*.html"), ("allow", "*://www.*.example.org/en/*"), ("allow", "*://docs.*/reference/*"),
    ("allow", "https://blog.*/fr/*/"), ("allow", "*://*.example.net/es/*7.html"),
]


def default_rules() -> list[Rule]:
    """(rule id, action, glob): the last rule that matches decides."""
    made = [("deny", f"*://{h}/*") for h in _HOSTS] + [("deny", f"*://*.{h}/*") for h in _HOSTS]
    made += [("deny", f"*.{x}") for x in _FILES] + [("deny", f"*.{x}?*") for x in _FILES[:8]]
    made += [("deny", f"*/{w}") for w in _WORDS] + [("deny", f"*/{w}/*") for w in _WORDS]
    made += [("deny", f"*{w}*") for w in _SPAM] + [("deny", g) for g in _ODD] + _SITE
    return [(i, action, glob) for i, (action, glob) in enumerate(made)]


def parse_glob(glob: str) -> list[str | None]:
    """Symbols of a glob: a character, ``?`` as None, ``*`` as ''. ``[x]`` is x itself, whatever x is."""
    out: list[str | None] = []
    i = 0
    while i < len(glob):
        if glob[i] == "[" and glob[i + 2 : i + 3] == "]":
            out.append(glob[i + 1])
            i += 3
            continue
        if glob[i] == "*":
            if not out or out[-1] != "":
                out.append("")
        else:
            out.append(None if glob[i] == "?" else glob[i])
        i += 1
    return out


class Automaton:
    """Packed masks of many globs and their simulation over a batch of strings."""

    def __init__(self, globs: Sequence[str]):
        parsed = [parse_glob(g) for g in globs]
        bits = sum(1 + sum(s != "" for s in p) for p in parsed)
        self.words = max(1, -(-bits // 64))
        alphabet = sorted({s for p in parsed for s in p if s})
        self.symbols = np.array([ord(s) for s in alphabet], np.uint32)
        size = len(alphabet) + 1  # the last class is every other character
        step = np.zeros((size, self.words), np.uint64)
        self.start, self.loop = np.zeros(self.words, np.uint64), np.zeros(self.words, np.uint64)
        self.last = np.zeros(len(globs), np.int64)
        rank = {s: i for i, s in enumerate(alphabet)}

        def put(row: np.ndarray, bit: int) -> None:
            row[bit // 64] |= np.uint64(1 << (bit % 64))

        at = 0
        for k, p in enumerate(parsed):
            put(self.start, at)
            for s in p:
                if s == "":
                    put(self.loop, at)
                    continue
                at += 1
                for c in range(size) if s is None else (rank[s],):
                    put(step[c], at)
            self.last[k] = at
            at += 1
        self.step = step

    def classes(self, points: np.ndarray) -> np.ndarray:
        i = np.searchsorted(self.symbols, points)
        i[i == len(self.symbols)] = 0
        return np.where(self.symbols[i] == points, i, len(self.symbols)) if len(self.symbols) else np.zeros(len(points), np.int64)

    def run(self, strings: Sequence[str]) -> np.ndarray:
        """A boolean matrix: string by glob."""
        n = len(strings)
        lengths = np.array([len(s) for s in strings], np.int64)
        order = np.argsort(-lengths, kind="stable")
        flat = self.classes(np.frombuffer("".join(strings).encode("utf-32-le", "surrogatepass"), np.uint32))
        starts = (np.cumsum(lengths) - lengths)[order]
        lengths = lengths[order]
        state = np.tile(self.start, (n, 1))
        one, top = np.uint64(1), np.uint64(63)
        for t in range(int(lengths[0]) if n else 0):
            live = int(np.searchsorted(-lengths, -t, side="left"))
            now = state[:live]
            moved = now << one
            moved[:, 1:] |= now[:, :-1] >> top
            moved &= self.step[flat[starts[:live] + t]]
            now &= self.loop
            now |= moved
        found = np.empty((n, len(self.last)), bool)
        found[order] = (state[:, self.last // 64] >> (self.last % 64).astype(np.uint64)) & one != 0
        return found


def canonical(url: Column) -> Column:
    """Lower-case scheme and host, no default port, no fragment, single slashes, no utm parameters.

    What isn't ``scheme://...`` is only trimmed and put in lower case; null stays null.
    """
    u = F.regexp_replace(F.trim(url), "#.*$", "")
    shape = r"^([A-Za-z][A-Za-z0-9+.-]*)://([^/?]*)([^?]*)(.*)$"
    scheme, host = F.lower(F.regexp_extract(u, shape, 1)), F.lower(F.regexp_extract(u, shape, 2))
    host = F.when(scheme == "http", F.regexp_replace(host, ":80$", "")).when(scheme == "https", F.regexp_replace(host, ":443$", "")).otherwise(host)
    path = F.regexp_replace(F.regexp_extract(u, shape, 3), "//+", "/")
    path = F.when(path == "", F.lit("/")).otherwise(path)
    query = F.regexp_replace(F.regexp_extract(u, shape, 4), r"([?&])(?:utm_[a-z]+=[^&]*(?:&|$))+", "$1")
    query = F.regexp_replace(query, "[?&]+$", "")
    return F.when(F.regexp_like(u, F.lit(shape)), F.concat(scheme, F.lit("://"), host, path, query)).otherwise(F.lower(u))


def filter_urls(pages: DataFrame, rules: Sequence[Rule] | None = None, *, url: str = "url", batch: int = 4096) -> DataFrame:
    """(page_id, url, verdict, n_rules, rules) for every page: its canonical URL and the rules it meets.

    ``rules`` lists the ids of matching rules in ascending order, joined by commas; ``verdict`` is the
    action of the highest, or "none". Defined cases: a null URL gives null url and verdict, 0 rules and
    empty ``rules``; the empty URL is matched as an empty string; repeated rows give repeated results;
    no rule gives "none"; other columns are dropped.
    """
    given = list(default_rules() if rules is None else rules)
    given.sort()
    ids, actions, machine = [r[0] for r in given], [r[1] for r in given], Automaton([r[2] for r in given])

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = np.array([str(i) for i in ids], object)
        for whole in batches:
            for part in (c.slice(at, batch) for c in textvec.chunks(whole, 1, 1 << 20) for at in range(0, c.num_rows, batch)):
                urls = part.column(1).to_pylist()
                found = machine.run([u or "" for u in urls])
                found[[u is None for u in urls]] = False
                joined, verdicts = [], []
                for row, u in zip(found, urls, strict=True):
                    hit = np.flatnonzero(row)
                    joined.append(",".join(names[hit]))
                    verdicts.append(None if u is None else actions[hit[-1]] if len(hit) else "none")
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), pa.array(verdicts, pa.string()), pa.array(found.sum(1), pa.int32()), pa.array(joined, pa.string())],
                    names=["page_id", "url", "verdict", "n_rules", "rules"],
                )

    slim = pages.select(F.col("page_id").cast("long").alias("page_id"), canonical(F.col(f"`{url}`")).alias("url"))
    return slim.mapInArrow(judge, "page_id long, url string, verdict string, n_rules int, rules string")


def op10_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_urls(common.table(spark, sf_dir, "pages"))


def _like(glob: str) -> str:
    special = {"%": "~%", "_": "~_", "~": "~~"}
    parts = re.findall(r"\[(.)\]|(\*+)|(\?)|(.)", glob, re.DOTALL)
    return "".join("%" if many else "_" if one else special.get(own or plain, own or plain) for own, many, one, plain in parts)


def _oracle() -> str:
    rows = ", ".join(f"({i}, '{a}', '{_like(g).replace(chr(39), chr(39) * 2)}')" for i, a, g in default_rules())
    shape = r"^([A-Za-z][A-Za-z0-9+.-]*)://([^/?]*)([^?]*)(.*)$"
    part = lambda k: f"regexp_extract(u, '{shape}', {k})"
    return f"""
WITH rules(id, action, pat) AS (VALUES {rows}),
t AS (SELECT page_id, row_number() OVER () AS k, regexp_replace(trim(url), '#.*$', '') AS u FROM pages),
p AS (SELECT *, lower({part(1)}) AS sch, lower({part(2)}) AS h, regexp_replace({part(3)}, '//+', '/', 'g') AS pa,
        rtrim(left({part(4)}, 1) || array_to_string(list_filter(string_split(substr({part(4)}, 2), '&'), x -> NOT regexp_full_match(x, 'utm_[a-z]+=(.|\n)*')), '&'), '?&') AS q FROM t),
c AS (SELECT page_id, k, CASE WHEN regexp_matches(u, '{shape}') THEN
        sch || '://' || CASE sch WHEN 'http' THEN regexp_replace(h, ':80$', '') WHEN 'https' THEN regexp_replace(h, ':443$', '') ELSE h END
        || CASE WHEN pa = '' THEN '/' ELSE pa END || q ELSE lower(u) END AS url FROM p)
SELECT page_id, any_value(url) AS url,
  CASE WHEN any_value(url) IS NULL THEN NULL ELSE coalesce(arg_max(action, id), 'none') END AS verdict,
  count(id)::INTEGER AS n_rules, coalesce(string_agg(id::VARCHAR, ',' ORDER BY id), '') AS rules
FROM c LEFT JOIN rules ON url LIKE pat ESCAPE '~' GROUP BY page_id, k"""


QUERIES = {"op10_url_filters": op10_url_filters}
ORACLES = {"op10_url_filters": _oracle()}
