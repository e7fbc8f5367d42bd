"""Parts of the queries' SQL, stated without the engine's own values: words, phrases and patterns stand here as text."""

from __future__ import annotations

STOP = "(" + ", ".join(
    f"'{w}'"
    for w in """a an the and or but not is are was were be been being do does did have has had i me my we our you your he she it they to of in for on with at by
    from up about into through during until against among when where who which what that this these those can will just should would could use used using may
    how why if than so as such also""".split()
) + ")"
TOK = "regexp_extract_all(lower({}), '([a-z0-9]+)', 1)"
NORM = "trim(regexp_replace(lower({}), '\\s+', ' ', 'g'))"
WORDS = "list_filter(regexp_split_to_array({}, '\\s+'), lambda w: w <> '')"
STRIP = "regexp_replace({}, '^\\s+|\\s+$', '', 'g')"
HOST = "lower(regexp_extract(coalesce(url, ''), '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]+)', 1))"
PATH = "regexp_extract(coalesce(url, ''), '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)', 1)"


def distinct(tokens: str) -> str:
    """A list without repeats, in its order."""
    return f"list_filter({tokens}, lambda t, i: list_position({tokens}, t) = i)"


def first_tokens(text: str, n: int | None) -> str:
    """The first n distinct tokens (all if None) that are no stop words."""
    kept = distinct(f"list_filter({TOK.format(text)}, lambda t: length(t) > 1 AND t NOT IN {STOP})")
    return kept if n is None else f"list_slice({kept}, 1, {n})"


LINES = """
lines AS (SELECT doc_id, i AS paragraph_index, i // 8 + 1 AS page_number, s[i + 1] AS text FROM
  (SELECT doc_id, s, unnest(range(len(s))) AS i FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS s FROM documents)))"""

# The sample lexicon's phrases: phrase, kind, code, score; and the words that refute a code.
PHRASES = (
    ("authorization.prior", "p", "authorization.prior", 1.0),
    ("this is", "p", "authorization.prior", 1.0),
    ("are the", "p", "authorization.prior", 1.0),
    ("have", "p", "authorization.prior", 0.6),
    ("appeals.filing", "p", "appeals.filing", 1.0),
    ("dans", "p", "appeals.filing", 1.0),
    ("nicht", "p", "appeals.filing", 1.0),
    ("oder", "p", "appeals.filing", 0.6),
    ("claims.timely filing", "d", "claims.timely_filing", 1.0),
    ("that the", "d", "claims.timely_filing", 1.0),
    ("thereof", "d", "claims.timely_filing", 1.0),
    ("tion", "d", "claims.timely_filing", 0.6),
    ("claims.general", "d", "claims.general", 1.0),
    ("with", "d", "claims.general", 1.0),
    ("from", "d", "claims.general", 0.6),
    ("eligibility.member", "d", "eligibility.member", 1.0),
    ("und der", "d", "eligibility.member", 1.0),
    ("einer", "d", "eligibility.member", 1.0),
    ("mit", "d", "eligibility.member", 0.6),
    ("pharmacy.formulary", "d", "pharmacy.formulary", 1.0),
    ("que la", "d", "pharmacy.formulary", 1.0),
    ("pour le", "d", "pharmacy.formulary", 1.0),
    ("avec", "d", "pharmacy.formulary", 0.6),
    ("payor.alpha", "j", "payor.alpha", 1.0),
    ("en la", "j", "payor.alpha", 1.0),
    ("por el", "j", "payor.alpha", 1.0),
    ("para", "j", "payor.alpha", 0.6),
    ("state.fl", "j", "state.fl", 1.0),
    ("of the", "j", "state.fl", 1.0),
    ("in the", "j", "state.fl", 1.0),
    ("onto", "j", "state.fl", 0.6),
    ("payor.beta", "j", "payor.beta", 1.0),
    ("license", "j", "payor.beta", 1.0),
    ("token", "j", "payor.beta", 1.0),
)
REFUTED = {"claims.timely_filing": "stupid", "pharmacy.formulary": "worthless"}
# What a query says if it means an entry, by kind and code.
ASKED = (
    ("d", "claims.general", ("with", "general")),
    ("d", "claims.timely_filing", ("that the", "thereof", "timely filing")),
    ("d", "eligibility.member", ("und der", "einer")),
    ("d", "pharmacy.formulary", ("que la", "pour le", "formulary")),
    ("j", "payor.alpha", ("en la", "por el", "alpha")),
    ("j", "payor.beta", ("license", "token", "beta")),
    ("j", "state.fl", ("of the", "in the", "fl")),
    ("p", "appeals.filing", ("dans", "nicht", "filing")),
    ("p", "authorization.prior", ("this is", "are the", "prior")),
)


def _has(phrase: str) -> str:
    return r"regexp_matches(n, '(^|[^\p{L}\p{N}_])" + phrase + r"([^\p{L}\p{N}_]|$)')" if len(phrase) <= 4 else f"contains(n, '{phrase}')"


def hits(columns: str, refute: bool) -> str:
    """A row per phrase of the lexicon in a text n of `norm`."""
    one = lambda p, k, c, s: f"SELECT {columns}, '{p}' AS phrase, '{k}' AS kind, '{c}' AS code, {s}::DOUBLE AS score FROM norm WHERE {_has(p)}" + (f" AND NOT contains(n, '{REFUTED[c]}')" if refute and c in REFUTED else "")
    return " UNION ALL ".join(one(*x) for x in PHRASES)


LEXICON = "lexicon(phrase, kind, code) AS (VALUES " + ", ".join(f"('{p}', '{k}', '{c}')" for p, k, c, _ in PHRASES) + ")"
TAGS = f"""{LINES},
norm AS MATERIALIZED (SELECT *, {NORM.format("text")} AS n FROM lines), hits AS ({hits("doc_id, paragraph_index, page_number", True)}),
line_tags AS MATERIALIZED (SELECT doc_id, paragraph_index, page_number, kind, code, max(score) AS score FROM hits GROUP BY ALL)"""
DOC_TAGS = f"""{TAGS},
doc_tags AS MATERIALIZED (SELECT doc_id, kind, code, count(*)::DOUBLE AS score FROM (SELECT DISTINCT doc_id, page_number, kind, code FROM line_tags) GROUP BY ALL)"""
HEAD = f"headed AS (SELECT *, len({TOK.format('text')}) AS n_words, len({TOK.format('text')}) BETWEEN 1 AND 15 AND NOT regexp_matches(rtrim(text, ' '), '[.,;:]$') AS is_heading FROM lines)"


def expand(source: str) -> str:
    """query_id, kind, code and place of the matching entries of a source of (query_id, text)."""
    plain = f"' ' || array_to_string({TOK.format('text')}, ' ') || ' '"
    one = " UNION ALL ".join(f"SELECT query_id, '{k}' AS kind, '{c}' AS code FROM plain WHERE " + " OR ".join(f"contains(n, ' {p} ')" for p in phrases) for k, c, phrases in ASKED)
    return f"plain AS (SELECT query_id, {plain} AS n FROM {source}), meant AS ({one}), expanded AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY kind, code) - 1 AS place FROM meant)"


SCORED = f"""{LINES}, post AS (SELECT doc_id, paragraph_index, t AS token, count(*) AS tf FROM (SELECT doc_id, paragraph_index, unnest({TOK.format("text")}) AS t FROM lines) GROUP BY ALL),
q0 AS (SELECT item_id AS query_id, {first_tokens("text", 7)} AS t FROM benchmark), q AS (SELECT query_id, len(t) AS n_tokens, unnest(t) AS token FROM q0),
s AS (SELECT query_id, doc_id, paragraph_index, n_tokens, count(*) AS matched, round(sum(tf * 0.1::DOUBLE), 9) AS s FROM q JOIN post USING (token) GROUP BY ALL),
found AS MATERIALIZED (SELECT query_id, doc_id, paragraph_index, n_tokens, matched, s / (s + 1) AS score FROM s)"""
CASCADE = """m AS (SELECT *, max(matched) OVER (PARTITION BY query_id) AS most FROM found),
l AS (SELECT *, CASE WHEN n_tokens >= 3 AND most >= greatest(3, ceil(n_tokens / 2)) THEN most ELSE 0 END AS level FROM m), c AS (SELECT * FROM l WHERE level = 0 OR matched = level)"""
TITLE = """titles AS (SELECT page_id, url, regexp_extract(html, '(?s)<h1[^>]*>(.*?)</h1>', 1) AS h1, regexp_extract(html, '(?s)<title[^>]*>(.*?)</title>', 1) AS t FROM pages),
named AS (SELECT page_id, substring(trim(CASE WHEN trim(h1) <> '' THEN h1 WHEN trim(t) <> '' THEN t ELSE url END), 1, 240) AS title FROM titles)"""
T = """t AS (SELECT event_id, ts, user_id, event_type, CASE event_type WHEN 'view' THEN 'a' WHEN 'click' THEN 'b' WHEN 'signup' THEN 'c' WHEN 'purchase' THEN 'd' ELSE 'natural' END AS strategy,
  round(value * 100, 0) AS total_ms, json_extract_string(props, '$.k')::BIGINT AS k FROM events)"""
C = f"""{T}, cells AS (SELECT event_id, user_id AS query_id, strategy, k % 100 / 100.0::DOUBLE AS recall, (k * 7) % 100 / 100.0::DOUBLE AS precision, k % 5 <> 0 AS answered,
  CASE WHEN k % 7 = 0 THEN 1 ELSE 0 END AS contradicted, total_ms AS latency_ms, CASE k % 4 WHEN 0 THEN 'correct' WHEN 1 THEN 'partial' WHEN 2 THEN 'wrong' ELSE 'unable_to_verify' END AS verdict,
  CASE WHEN k % 11 = 0 THEN 'correct' WHEN k % 13 = 0 THEN 'wrong' END AS human_verdict, (k * 3) % 100 / 100.0::DOUBLE AS confidence,
  CASE k % 3 WHEN 0 THEN 'factual' WHEN 1 THEN 'conceptual' ELSE 'vague' END AS query_class, ts::DATE AS day, k FROM t)"""
AUTHORITY = "CASE WHEN quality = 1 THEN 'contract_source_of_truth' WHEN quality = 0 THEN 'payer_policy' ELSE 'unknown' END"
# The documents' metadata: payer, state and authority from the roles of the test tables.
META = f"""meta AS (SELECT d.doc_id, source AS payer, upper(lang) AS state, CASE WHEN toxic = 1 THEN 'Medicaid' ELSE 'Commercial' END AS program, {AUTHORITY} AS authority_level,
  source || '_' || lang || '-' || d.doc_id::VARCHAR AS name FROM documents d LEFT JOIN labels USING (doc_id))"""
# What questions begin with, where no letter, mark, digit or underscore stands before it (\b would know those of ASCII only), and words that say nothing; the question without them, and the normalised question.
LEAD = r"""(^|[^\p{L}\p{Mn}\p{Nd}_])(how\s+many|how\s+much|how\s+long|how\s+often|how\s+do\s+i|how\s+can\s+i|how\s+do\s+you|how\s+is|how\s+are|how\s+does|what\s+is\s+the|what\s+are\s+the|what\s+does|what\s+do\s+i|when\s+do\s+i|when\s+can\s+i|when\s+is|where\s+do\s+i|where\s+can\s+i|who\s+can\s+i|who\s+do\s+i|can\s+i|do\s+i|have\s+to|need\s+to|is\s+there\s+a|are\s+there\s+any)"""
BARE = f"array_to_string(list_filter({WORDS.format(f'''regexp_replace(text, '(?i){LEAD}', '\\1 ', 'g')''')}, lambda x: lower(x) NOT IN ('many', 'much', 'often', 'several', 'various', 'certain', 'few', 'some', 'any', 'every', 'all', 'most', 'more')), ' ')"
NORMAL_QUERY = f"CASE WHEN ({BARE}) = '' THEN text ELSE {BARE} END"
#: All phrases of each entry: also the general words that match none.
WHOLE_BAGS = tuple((k, c, (*phrases, "member") if c == "eligibility.member" else phrases) for k, c, phrases in ASKED)
