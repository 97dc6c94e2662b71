r"""URL filters: pattern rules indexed by their rarest literal token.

Method. A rule is a text with ``*`` (any characters), ``^`` (a separator or the end), ``|`` at an end
(start or end of the URL) and ``||`` at the start (start of the host or of a subdomain label). Its
literal tokens are runs of letters, digits, ``%`` and characters beyond ASCII that the rule bounds on
both sides, so a URL that fits the rule has each of them as a whole token. Tokens are counted over
all URLs, and every rule is filed under its rarest one. The tokens of a URL fetch the rules filed
under them; only those, and the rules without such a token, run their regular expressions.

The verdict is that of the longest fitting site rule (host and path); without one, an allowing
pattern beats a blocking one and a longer pattern a shorter one; without any, it is ``allow``.

Up to ``INDEX_BYTES`` of rules travel as an index that each task looks tokens up in, without a
shuffle; more rules meet the tokens in a join (``judge_by_join``) with the same result.

Defined cases: a null URL or one without ``://`` has an empty host and path, and patterns see it after
a colon, so no anchored one fits; only A-Z of the host are lower-cased, patterns tell cases apart in the rest; repeated rows are judged each;
other columns are ignored, an empty table gives an empty result; repeated rules count once, and of
equally long ones the first in byte order decides.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Sequence
from dataclasses import dataclass
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docscreen.llm.common import cut_lineage, map_batches, read

#: Rules of a site: action, host and path.
SITE_RULES = (("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"),
              ("block", "net/es/"), ("block", "net/fr/"))
#: Patterns for everything that no site rule decides.
PATTERNS = (("block", "||casino*^"), ("block", "||*.casino*^"), ("block", "||adult-"), ("block", "||free-bets."),
            ("block", "||spam-farm.example.org^"), ("block", "||spam-farm."), ("block", "||*.xxx^"),
            ("block", "/banners/"), ("block", "^adserver^"), ("block", "/track/*/click?"), ("block", ".exe|"),
            ("block", "?sessionid="), ("allow", "||archive.org^"), ("allow", "/robots.txt|"))
#: Bytes of rules up to which each task holds the index.
INDEX_BYTES = 64 << 20

_TOKEN = r"[A-Za-z0-9%\x{80}-\x{10FFFF}]+"
_TOKEN_PY = re.compile("[A-Za-z0-9%\u0080-\U0010ffff]+")
_SEPARATOR = "(?:[^A-Za-z0-9_.%\u0080-\U0010ffff-]|$)"
_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


@dataclass(frozen=True)
class Rule:
    action: str
    text: str
    site: bool = False

    @property
    def pattern(self) -> str:
        return "||" + self.text if self.site else self.text

    def regex(self) -> str:
        """For a URL written as ``//host path...``; the same for Python and for Java."""
        text, out = self.pattern, ""
        if text.startswith("||"):
            text, out = text[2:], r"^//(?:[^/?#]*\.)?"
        elif text.startswith("|"):
            text, out = text[1:], "^"
        end = r"\Z" if text.endswith("|") else ""
        text = text[:-1] if end else text
        for c in text:
            out += r"[\s\S]*" if c == "*" else _SEPARATOR.replace("$", r"\Z") if c == "^" else (
                c if c.isascii() and c.isalnum() or not c.isascii() else "\\" + c)
        return out + end

    def tokens(self) -> list[str]:
        """Tokens that every fitting URL has whole, A-Z lower-cased."""
        text, left = self.pattern, False
        if text.startswith("||"):
            text, left = text[2:], True
        elif text.startswith("|"):
            text, left = text[1:], True
        right = text.endswith("|")
        text = text[:-1] if right else text
        out = []
        for m in _TOKEN_PY.finditer(text):
            before = left if m.start() == 0 else text[m.start() - 1] != "*"
            after = right if m.end() == len(text) else text[m.end()] != "*"
            if before and after:
                out.append(m.group().translate(_LOWER))
        return sorted(set(out))

    def order(self) -> tuple:
        """Smaller decides: site rules, longest first; then allowing patterns, longest first."""
        return (not self.site, self.action != "allow" and not self.site, -len(self.text), self.text, self.action)


def rules_of(sites: Iterable[Sequence[str]] = SITE_RULES, patterns: Iterable[Sequence[str]] = PATTERNS) -> list[Rule]:
    """Distinct rules in the order in which they decide."""
    return sorted({*(Rule(a, t, True) for a, t in sites), *(Rule(a, t) for a, t in patterns)}, key=Rule.order)


def _parts(url: Column) -> tuple[Column, Column, Column]:
    """Host, path and what follows."""
    has = F.coalesce(F.contains(url, F.lit("://")), F.lit(False))
    after = F.substr(url, F.instr(url, "://") + 3)
    host = F.regexp_extract(after, r"^[^/?#]*", 0)
    beyond = F.regexp_replace(after, r"^[^/?#]*", "")
    path = F.regexp_extract(beyond, r"^[^?#]*", 0)
    small = F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return (F.when(has, small).otherwise(""), F.when(has, path).otherwise(""),
            F.when(has, F.regexp_replace(beyond, r"^[^?#]*", "")).otherwise(F.coalesce(url, F.lit(""))))


def prepared(pages: DataFrame, row_id: str = "page_id", url: str = "url") -> DataFrame:
    """row_id, host, path and line: ``//host path...`` or ``:url``, which the rules are matched against."""
    host, path, rest = _parts(F.col(url))
    return (pages.select(F.col(row_id), host.alias("host"), path.alias("path"), rest.alias("_rest"),
                         F.contains(F.col(url), F.lit("://")).alias("_has"))
            .select(row_id, "host", "path", F.when(F.col("_has"), F.concat(F.lit("//"), "host", "path", "_rest"))
                    .otherwise(F.concat(F.lit(":"), "_rest")).alias("line")))


def _line_tokens(line: Column) -> Column:
    return F.array_distinct(F.transform(
        F.regexp_extract_all(line, F.lit(_TOKEN), F.lit(0)),
        lambda t: F.translate(t, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")))


def token_counts(lines: DataFrame, rules: Sequence[Rule]) -> dict[str, int]:
    """URLs that have each token of a rule: as many rows as the rules have tokens."""
    spark = lines.sparkSession
    wanted = sorted({t for r in rules for t in r.tokens()})
    if not wanted:
        return {}
    asked = spark.createDataFrame([(t,) for t in wanted], "token string")
    found = (lines.select(F.explode(_line_tokens(F.col("line"))).alias("token"))
             .groupBy("token").agg(F.count(F.lit(1)).alias("n")).join(asked, "token"))
    return dict.fromkeys(wanted, 0) | {r.token: r.n for r in found.collect()}


def filed(rules: Sequence[Rule], counts: dict[str, int]) -> list[str | None]:
    """The rarest token of each rule (of equally rare ones the longest, then the first); None without one."""
    return [min(t, key=lambda x: (counts.get(x, 0), -len(x), x)) if (t := r.tokens()) else None for r in rules]


@lru_cache(maxsize=1 << 16)
def _compiled(regex: str) -> re.Pattern:
    return re.compile(regex)


def deciding(line: str, index: dict[str, list[int]], rules: Sequence[Rule], regexes: Sequence[str],
             ran: list[int] | None = None) -> int | None:
    """Place of the first rule that fits; ``ran`` (for tests) collects the rules that were tried."""
    asked = list(index.get("", ()))
    for token in {t.translate(_LOWER) for t in _TOKEN_PY.findall(line)}:
        asked += index.get(token, ())
    for i in sorted(asked):
        if ran is not None:
            ran.append(i)
        if _compiled(regexes[i]).search(line):
            return i
    return None


def index_of(rules: Sequence[Rule], tokens: Sequence[str | None]) -> dict[str, list[int]]:
    """Token to places of rules; rules without a token are under the empty one."""
    out: dict[str, list[int]] = {}
    for i, t in enumerate(tokens):
        out.setdefault(t or "", []).append(i)
    return out


def _named(found: DataFrame) -> DataFrame:
    """Row id, host, path and the deciding rule as columns."""
    return found.select(
        "*", F.when(F.col("_rule.site"), F.col("_rule.text")).alias("rule"),
        F.coalesce("_rule.action", F.lit("allow")).alias("verdict"),
        F.when(~F.col("_rule.site"), F.col("_rule.text")).alias("pattern")).drop("_rule", "line")


def judge(pages: DataFrame, rules: Sequence[Rule] | None = None, row_id: str = "page_id", url: str = "url",
          index_bytes: int = INDEX_BYTES) -> DataFrame:
    """row_id, host, path, rule, verdict and pattern for every row."""
    rules = rules_of() if rules is None else sorted(set(rules), key=Rule.order)
    lines = prepared(pages, row_id, url)
    tokens = filed(rules, token_counts(lines, rules))
    regexes = [r.regex() for r in rules]
    if sum(len(x.encode()) for x in regexes) > index_bytes:
        return judge_by_join(lines, rules, tokens, row_id)
    shared = pages.sparkSession.sparkContext.broadcast((index_of(rules, tokens), rules, regexes))

    def work(batch: pa.RecordBatch) -> list:
        index, own, regex = shared.value
        found = [deciding(line, index, own, regex) for line in batch.column(3).to_pylist()]
        return [batch.column(0), batch.column(1), batch.column(2), [
            None if i is None else {"site": own[i].site, "text": own[i].text, "action": own[i].action}
            for i in found]]

    kind = pages.schema[row_id].dataType.simpleString()
    return _named(map_batches(lines, work, f"`{row_id}` {kind}, host string, path string, "
                              "_rule struct<site: boolean, text: string, action: string>"))


def judge_by_join(lines: DataFrame, rules: Sequence[Rule], tokens: Sequence[str | None], row_id: str) -> DataFrame:
    """The same with rules as a table: tokens of URLs join the tokens that rules are filed under."""
    spark = lines.sparkSession
    rows = cut_lineage(lines.withColumn("_row", F.monotonically_increasing_id()))
    table = cut_lineage(spark.createDataFrame(
        [(t or "", i, r.regex(), r.site, r.text, r.action) for i, (r, t) in enumerate(zip(rules, tokens, strict=True))],
        "token string, place int, regex string, site boolean, text string, action string"))
    asked = rows.select("_row", "line", F.explode(F.concat(F.array(F.lit("")), _line_tokens(F.col("line"))))
                        .alias("token"))
    fits = F.regexp(F.col("line"), F.regexp_replace("regex", r"\\Z", r"\\z"))
    best = (asked.join(table, "token").filter(fits)
            .groupBy("_row").agg(F.min(F.struct("place", "site", "text", "action")).alias("_rule")))
    return _named(rows.join(best, "_row", "left").drop("_row"))


def query(spark, sf_dir: str) -> DataFrame:
    return judge(read(spark, sf_dir, "pages"))


def _text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def _oracle() -> str:
    sites = ", ".join(f"({_text(a)}, {_text(t)}, {_text(t[:t.index('/')])}, {_text(t[t.index('/'):])})"
                      for a, t in SITE_RULES)
    patterns = ", ".join(f"({i}, {_text(r.action)}, {_text(r.text)}, {_text(_re2(r))})"
                         for i, r in enumerate(rules_of((), PATTERNS)))
    return f"""
with u as (select page_id, url, coalesce(contains(url, '://'), false) as has,
    substr(url, strpos(url, '://') + 3) as after from pages),
h as (select page_id, has, url, case when has then translate(regexp_extract(after, '^[^/?#]*'),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') else '' end as host,
    case when has then regexp_replace(after, '^[^/?#]*', '') else '' end as beyond from u),
p as (select page_id, host, case when has then regexp_extract(beyond, '^[^?#]*') else '' end as path,
    case when has then '//' || host || beyond else ':' || coalesce(url, '') end as line from h),
sites(action, text, rule_host, rule_path) as (values {sites}),
patterns(place, action, text, regex) as (values {patterns}),
judged as (select p.*,
    (select max(struct_pack(n := length(text), text := text, action := action)) from sites
     where (host = rule_host or ends_with(host, '.' || rule_host)) and starts_with(path, rule_path)) as s,
    (select min(struct_pack(place := place, text := text, action := action)) from patterns
     where regexp_matches(line, regex)) as m from p)
select page_id, host, path, s.text as rule, coalesce(s.action, m.action, 'allow') as verdict,
  case when s is null then m.text end as pattern from judged"""


def _re2(rule: Rule) -> str:
    return (rule.regex().replace("\u0080-\U0010ffff", r"\x{80}-\x{10ffff}").replace(r"\Z", r"\z")
            .replace(r"[\s\S]", r"(?s:.)"))


ORACLE = _oracle()
