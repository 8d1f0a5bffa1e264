"""SQL that the text queries are checked against, written for DuckDB.

The SQL spells the semantics out with its own means (character lists instead of
back-references, consuming word edges instead of look-around); only the word lists
and the generated word patterns are shared.
"""

from __future__ import annotations

from modspark.functions import text as T
from modspark.operators import lexicon as L
from modspark.operators import rules as R
from modspark.operators import verdict as V

W = r"[\p{L}\p{N}_]"
NW = r"[^\p{L}\p{N}_]"


def lit(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def cap(column: str) -> str:
    """Runs cut to two, over a character list column."""
    return (f"array_to_string(list_filter({column}, lambda c, i: i <= 2 or c = chr(10) or c <> {column}[i-1]"
            f" or c <> {column}[i-2]), '')")


def collapse(column: str) -> str:
    return f"array_to_string(list_filter({column}, lambda c, i: i = 1 or c = chr(10) or c <> {column}[i-1]), '')"


def words(x: str) -> str:
    return rf"list_filter(regexp_split_to_array({x}, '[^\p{{L}}\p{{N}}]+'), lambda t: t <> '')"


def compact(x: str) -> str:
    return rf"regexp_replace({x}, '[^a-zA-Z0-9\x{{0600}}-\x{{06FF}}]', '', 'g')"


SPACES = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || chr(160)"


def bundle(source: str) -> str:
    """CTEs src(k, raw) .. bundle with every form, from a select of (k, raw)."""
    pairs = f"lower(folded)"
    for a, b in T.LATIN_ARABIC_PAIRS:
        pairs = f"replace({pairs}, {lit(a)}, {lit(b)})"
    look = (T.CYRILLIC_LOOKALIKES[0] + T.GREEK_LOOKALIKES[0], T.CYRILLIC_LOOKALIKES[1] + T.GREEK_LOOKALIKES[1])
    return f"""
src as materialized ({source}),
s1 as (select k, raw, trim(raw, {SPACES}) as cleaned from src),
s2 as (select *, translate(cleaned, {lit(look[0])}, {lit(look[1])}) as homoglyphs from s1),
s3 as (select *, string_split(translate(homoglyphs, 'أإآٱىئةؤ', 'ااااييهو'), '') as ch from s2),
s4 as (select * exclude (ch), {cap('ch')} as folded,
       translate(lower(homoglyphs), {lit(T.LEET[0])}, {lit(T.LEET[1])}) as leet from s3),
s5 as (select *, translate({pairs}, {lit(T.LATIN_ARABIC_DIGITS[0])}, {lit(T.LATIN_ARABIC_DIGITS[1])}) as latin_arabic from s4),
s6 as (select *, {compact('folded')} as compact_ar, {compact('leet')} as compact_leet, {compact('latin_arabic')} as compact_arab,
       regexp_replace(folded, '[^a-zA-Z\\x{{0600}}-\\x{{06FF}}]', '', 'g') as letters_only from s5),
s7 as (select *, string_split(compact_ar, '') as c1, string_split(compact_leet, '') as c2, string_split(compact_arab, '') as c3 from s6),
bundle as materialized (select * exclude (c1, c2, c3), {collapse('c1')} as compact_collapsed, {collapse('c2')} as compact_leet_collapsed,
       {collapse('c3')} as compact_arab_collapsed,
       list_distinct(list_concat(list_concat({words('folded')}, {words('leet')}), list_concat({words('latin_arabic')}, {words('lower(homoglyphs)')}))) as tokens
       from s7)"""


# The rules' shapes, with edges that take letters along where RE2 cannot look around.
NO_WORD_BEFORE, NO_WORD_AFTER = "(?<!" + R.WORD + ")", "(?!" + R.WORD + ")"
BEGIN, END = "(?:^|" + NW + ")", "(?:" + NW + "|$)"
PHONE = "(" + R.PHONE.replace(NO_WORD_AFTER, ")" + END)
EMAIL = R.EMAIL.replace(R.EDGE, r"\b")
STATED = R.STATED_NAME.replace(NO_WORD_BEFORE, BEGIN).replace(NO_WORD_AFTER, END)
SHORT = R.SHORT_NAME.replace(NO_WORD_BEFORE, BEGIN).replace(NO_WORD_AFTER, END)
AGE = R.STATED_AGE.replace(NO_WORD_BEFORE, BEGIN + "(").replace(NO_WORD_AFTER, ")" + END)
LINK = R.LINK.replace("(?<!" + R.WORD + ")", r"\b")


def phone(x: str) -> str:
    found = f"regexp_extract({x}, {lit(PHONE)}, 1)"
    return f"case when length(regexp_replace({found}, '[^0-9]', '', 'g')) >= 8 then {found} end"


def email(x: str) -> str:
    return f"nullif(regexp_extract({x}, {lit(EMAIL)}), '')"


def name(x: str) -> str:
    return ("coalesce(" + ", ".join(
        f"case when length(regexp_extract({x}, {lit(p)}, 1)) >= 2 then regexp_extract({x}, {lit(p)}, 1) end" for p in (STATED, SHORT)) + ")")


def age(x: str) -> str:
    return f"nullif(regexp_extract({x}, {lit(AGE)}, 1), '')"


def link(x: str) -> str:
    return f"nullif(regexp_extract({x}, {lit(LINK)}), '')"


def pii_category(x: str) -> str:
    return (f"case when {phone(x)} is not null then 'phone_number' when {email(x)} is not null then 'email_address'"
            f" when {name(x)} is not null or {age(x)} is not null then 'pii_self_doxx' end")


def pii_severity(x: str) -> str:
    return (f"case when {phone(x)} is not null or {email(x)} is not null or {name(x)} is not null then 'high'"
            f" when {age(x)} is not null then 'medium' end")


def pii_item(x: str) -> str:
    return f"coalesce({phone(x)}, {email(x)}, {name(x)}, {age(x)})"


def lexicon_values(terms=L.DEMO_TERMS) -> str:
    """lex(ord, term, folded, collapsed, category, severity, kind, script, critical)."""
    fold = str.maketrans("أإآٱىئةؤ", "ااااييهو")
    rows = []
    for i, (term, category, severity, kind, script, _, critical) in enumerate(terms):
        folded = term.translate(fold) if script == "ar" else term.lower()
        collapsed = "".join(c for j, c in enumerate(folded) if j == 0 or folded[j - 1] != c)
        rows.append(f"({i}, {lit(term)}, {lit(folded)}, {lit(collapsed)}, {lit(category)}, {lit(severity)}, {lit(kind)}, "
                    f"{lit(script)}, {str(critical).lower()})")
    return ("lex(ord, term, folded, collapsed, category, severity, kind, script, critical) as (values "
            + ", ".join(rows) + ")")


EXCUSED = (
    "not l.folded in (" + ", ".join(lit(h) for h in L.HARD_TERMS) + ") and len(list_filter(tokens, lambda t: lower(t) in ("
    + ", ".join(lit(a) for a in L.DEMO_ALLOWED) + ") and contains(lower(t), l.folded) and lower(t) <> l.folded)) > 0")
COMPACTS = "[compact_ar, compact_collapsed, compact_leet, compact_leet_collapsed, compact_arab, compact_arab_collapsed]"


def frame(x: str) -> str:
    return f"chr(1) || regexp_replace(lower({x}), '[^\\p{{L}}\\p{{N}}_ ]', chr(1), 'g') || chr(1)"


def begins(f: str, word: str) -> str:
    return f"(contains({f}, ' ' || {word}) or contains({f}, chr(1) || {word}))"


def whole(f: str, word: str) -> str:
    return "(" + " or ".join(f"contains({f}, {a} || {word} || {b})" for a in ("' '", "chr(1)") for b in ("' '", "chr(1)")) + ")"


def hits(lexicon: str | None = None, links: bool = True) -> str:
    """CTEs after ``bundle``: hits(k, layer, variant, ord, rule_id, category, severity, confidence, item, term)."""
    inside = (f"len(list_filter({COMPACTS}, lambda v: (length(l.folded) >= 3 and contains(v, l.folded))"
              " or (length(l.collapsed) >= 3 and contains(v, l.collapsed)))) > 0")
    forms8 = ["raw", "folded", "leet", "latin_arabic", "compact_ar", "compact_collapsed", "compact_leet", "compact_arab"]
    forms5 = ["raw", "folded", "leet", "latin_arabic", "homoglyphs"]
    said = ["raw", "folded", "leet", "latin_arabic", "compact_ar"]
    frames = ("f_leet", "f_latin_arabic", "f_folded")
    en_stem = "(" + " or ".join(begins(f, f"l.{w}") for f in frames for w in ("folded", "collapsed")) + f" or {inside})"
    en_exact = "(" + " or ".join(whole(f, "l.folded") for f in frames) + ")"
    parts = [f"""select k, 0 as layer, 0 as variant, l.ord, 'RULE_LEGACY_FAST_PRECHECK' as rule_id, 'profanity' as category,
      'high' as severity, 1.0::double as confidence, l.term as item, l.folded as term
      from framed b, lex l where l.kind = 'legacy' and {whole('f_folded', 'l.folded')} and not ({EXCUSED})""",
        f"""select k, 1, 0, 0, 'RULE_PII_LEAK', coalesce({pii_category('raw')}, {pii_category('folded')}),
      coalesce({pii_severity('raw')}, {pii_severity('folded')}), 0.95, coalesce({pii_item('raw')}, {pii_item('folded')}), ''
      from bundle where coalesce({pii_item('raw')}, {pii_item('folded')}) is not null"""]
    if links:
        parts.append(f"select k, 2, 0, 0, 'RULE_ALL_LINKS', 'link', 'high', 1.0, {link('raw')}, '' from bundle where {link('raw')} is not null")
    # Patterns stand as constants, one select each: a pattern read from a table would
    # be compiled again for every row.
    for i, (_, category, severity, _, _, _, critical) in enumerate(L.DEMO_TERMS):
        folded = L.DEMO_TERMS[i][0]
        if not critical:
            continue
        evasive, insertion = lit(L.evasive_pattern(folded)), lit(L.insertion_pattern(folded))
        for v, f in enumerate(forms8):
            parts.append(f"""select k, 3, {v}, {i}, 'RULE_EVASIVE_REGEX', '{category}', '{severity}', 0.98, regexp_extract({f}, {evasive}, 1), {lit(folded)}
      from bundle where regexp_matches({f}, {evasive})""")
        for v, f in enumerate(forms5):
            parts.append(f"""select k, 4, {v}, {i}, 'RULE_CHARACTER_INSERTION', '{category}', '{severity}', 0.98, regexp_extract({f}, {insertion}, 1), {lit(folded)}
      from bundle where regexp_matches({f}, {insertion}) and not ({EXCUSED.replace('l.folded', lit(folded))})""")
    for i, f in enumerate(said):
        parts.append(f"""select k, 5, {i}, l.ord, 'RULE_ABUSIVE_PHRASE', l.category, l.severity, 0.99, l.folded, l.folded
      from framed b, lex l where l.kind = 'phrase' and contains(lower(b.{f}), l.folded)""")
    parts.append(f"""select k, 6, 0, l.ord, case l.kind when 'stem' then 'RULE_AR_DICT_STEM' else 'RULE_AR_DICT_EXACT' end, l.category, l.severity,
      0.95, l.term, l.folded from framed b, lex l where l.script = 'ar' and l.kind in ('stem', 'exact')
      and case l.kind when 'stem' then contains(lower(b.folded), l.folded) or contains(lower(b.folded), l.collapsed) or {inside}
      else {whole('f_folded', 'l.folded')} end and not ({EXCUSED})""")
    parts.append(f"""select k, 7, 0, l.ord, case l.kind when 'stem' then 'RULE_EN_DICT_STEM' else 'RULE_EN_DICT_EXACT' end, l.category, l.severity,
      0.95, l.folded, l.folded from framed b, lex l where l.script in ('en', 'arabizi') and l.kind in ('stem', 'exact')
      and case l.kind when 'stem' then {en_stem} else {en_exact} end and not ({EXCUSED})""")
    return f"""{lexicon or lexicon_values()}, framed as materialized (select *, {frame('folded')} as f_folded, {frame('leet')} as f_leet,
  {frame('latin_arabic')} as f_latin_arabic from bundle), hits as materialized ({" union all ".join(parts)})"""


DOCS = "select doc_id as k, text as raw from documents"
ITEMS = "select 'b/' || item_id as k, text as raw from benchmark"


def verdicts(source: str = DOCS, off: tuple[str, ...] = (), links: bool = True, lexicon: str | None = None) -> str:
    """CTEs ending in verdicts(k, is_allowed, action, category, severity, confidence, rule_id, item)."""
    skip = f"where category not in ({', '.join(lit(c) for c in off)})" if off else ""
    return f"""{bundle(source)}, {hits(lexicon, links)},
best as (select *, row_number() over (partition by k order by layer, variant, ord) as rn from hits {skip}),
verdicts as (select s.k, b.k is null as is_allowed, case when b.k is null then 'ALLOW' else 'BLOCK' end as action,
  coalesce(b.category, 'none') as category, coalesce(b.severity, 'low') as severity, coalesce(b.confidence, 1.0) as confidence,
  b.rule_id, b.item from src s left join best b on s.k = b.k and b.rn = 1)"""


MESSAGE = ("case when is_allowed then '' when category in ('explicit','sexual') then 'Rejected: sexual or explicit wording.'"
           " when category in ('threat','violence') then 'Rejected: threats or incitement to violence.'"
           " when category = 'self_harm' then 'Rejected: signs of self-harm.'"
           " when category in ('hate','slur') then 'Rejected: hate speech.'"
           " when category in ('harassment','bullying') then 'Rejected: bullying or harassment.'"
           " else 'Rejected: insulting or abusive wording.' end")


def hash_fold(x: str) -> str:
    return f"string_split(translate(lower({x}), 'أإآٱىة', 'اااايه'), '')"


def escape(x: str) -> str:
    out = f"trim({x}, {SPACES})"
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        out = f"replace({out}, {lit(a)}, {lit(b)})"
    return out


def redacted(x: str) -> str:
    out = x
    for pattern, by in T.REDACTIONS:
        for edge in (NO_WORD_BEFORE, NO_WORD_AFTER, "(?=" + R.WORD + ")", "(?<=" + R.WORD + ")"):
            pattern = pattern.replace(edge, r"\b")
        out = f"regexp_replace({out}, {lit(pattern)}, {lit(by.replace('$1', chr(92) + '1'))}, 'g')"
    return out


STRINGS = ("cleaned", "homoglyphs", "folded", "leet", "latin_arabic", "compact_ar", "compact_collapsed", "compact_leet",
           "compact_leet_collapsed", "compact_arab", "compact_arab_collapsed", "letters_only")
HIT_ROWS = ("select k as doc_id, rule_id, term, item from (select *, row_number() over (partition by k, rule_id, term"
            " order by variant, ord) as rn from hits where layer in ({layers})) where rn = 1")
SIGNALS = """signals as (select conv_id as payload_id, turn::int as ordinal, upper(role) as source,
  ['profanity','hate','link','bullying','media_unsafe'][length(text) % 5 + 1] as category,
  ['low','medium','high','critical'][length(text) % 4 + 1] as severity, (length(text) % 10) / 10.0::double as confidence,
  length(text) % 2 = 0 as is_violation, role = 'system' and length(text) % 3 = 0 as is_security,
  ['unsupported type','macro found','wording'][length(text) % 3 + 1] as reason, md5(text) as detected_item from conversations),
counted as (select *, length(severity) as x, case severity when 'critical' then 4 when 'high' then 3 when 'medium' then 2 else 1 end as score
  from signals where is_violation and (is_security or category <> 'link'))"""


def _fuzzy(terms: tuple[str, ...]) -> str:
    values = ", ".join(f"({lit(t)})" for t in terms)
    return f"""with w as (select distinct t as token from (select unnest({words('lower(text)')}) as t from documents) where length(t) between 3 and 8),
      p as (select token, term, damerau_levenshtein(regexp_replace(token, '[^\\x00-\\x7f]', chr(1), 'g'), term) as d
        from w, (values {values}) v(term) where length(token) >= 4 and abs(length(token) - length(term)) <= 1)
      select token, term, round(1.0 - d::double / greatest(length(token), length(term)), 6) as sim from p where d <= 1
        and (1.0 - d::double / greatest(length(token), length(term)) >= 0.8 or list_sort(string_split(token, '')) = list_sort(string_split(term, '')))"""


def _close(token: str, term: str) -> str:
    """Distance in characters: one byte stands for any letter outside ASCII, which no term holds."""
    return f"damerau_levenshtein(regexp_replace({token}, '[^\\x00-\\x7f]', chr(1), 'g'), {term})"


def _fuzzy_long(terms: tuple[str, ...]) -> str:
    values = ", ".join(f"({lit(t)})" for t in terms)
    return f"""with w as (select distinct t as token from (select unnest({words('lower(text)')}) as t from documents)),
      p as (select token, term, {_close('token', 'term')} as d from w, (values {values}) v(term)
        where length(token) >= 4 and abs(length(token) - length(term)) <= 2)
      select token, term, round(1.0 - d::double / greatest(length(token), length(term)), 6) as sim from p
        where d <= 2 and 1.0 - d::double / greatest(length(token), length(term)) >= 0.75"""


def complete(source: str = DOCS, off: tuple[str, ...] = (), links: bool = True, lexicon: str | None = None) -> str:
    """CTEs ending in complete(...): the verdicts with layer 8 for messages nothing else decided."""
    terms = ", ".join(f"({i}, {lit(t)}, {lit(c)}, {lit(s)})" for i, (t, c, s, _, _, fuzzy, _) in enumerate(L.DEMO_TERMS) if fuzzy and c not in off)
    allowed = ", ".join(lit(a) for a in L.DEMO_ALLOWED)
    near = "v.is_allowed and f.k is not null"
    return f"""{verdicts(source, off, links, lexicon)},
      z(ord, term, category, severity) as (values {terms}),
      every as (select k, list_concat(list_concat({words('folded')}, {words('leet')}), list_concat({words('latin_arabic')}, {words('lower(homoglyphs)')})) as ts from bundle),
      u as (select k, lower(unnest(ts)) as t, unnest(range(len(ts))) as p from every),
      d as (select distinct t from u where length(t) >= 4 and t not in ({allowed})),
      x as (select t, z.*, {_close('t', 'term')} as dist, greatest(length(t), length(term)) as longest, case when length(term) <= 6 then 1 else 2 end as most
        from d, z where abs(length(t) - length(term)) <= 2),
      m as (select *, 1.0 - dist::double / longest as sim from x where dist <= most and (1.0 - dist::double / longest >= case when most = 1 then 0.8 else 0.75 end
        or (most = 1 and list_sort(string_split(t, '')) = list_sort(string_split(term, '')))) and 1.0 - dist::double / longest >= 0.75),
      f as (select u.k, m.*, row_number() over (partition by u.k order by u.p, m.ord) as rn from u join m using (t)),
      complete as (select v.k, v.is_allowed and f.k is null as is_allowed, case when v.is_allowed and f.k is null then 'ALLOW' else 'BLOCK' end as action,
        case when {near} then f.category else v.category end as category, case when {near} then f.severity else v.severity end as severity,
        case when {near} then round(f.sim, 2) else v.confidence end as confidence, case when {near} then 'RULE_BOUNDED_FUZZY' else v.rule_id end as rule_id,
        case when {near} then f.term else v.item end as item
      from verdicts v left join f on f.k = v.k and f.rn = 1)"""


def noisy(seeds: int) -> str:
    """Copies (k, raw) of the toxic documents with noise, letter by letter."""
    marks = "[" + ", ".join(lit(m) for m in V.NOISE) + "]"
    drawn = "md5(md5(text) || '/' || seed || '/' || (i - 1))"
    return f"""select doc_id || '/' || seed as k, array_to_string(list_transform(string_split(text, ''), lambda c, i:
        c || case when substr({drawn}, 1, 1) < '4' then c else '' end || ({marks})[('0x' || substr({drawn}, 2, 1))::int + 1]), '') as raw
      from documents, range({seeds}) r(seed) where doc_id in (select doc_id from labels where toxic = 1)"""


def custom_lexicon() -> str:
    base = lexicon_values()
    n = len(L.DEMO_TERMS)
    return base[:-1].replace("lex(", "lex0(", 1) + f"""), lex as (select * from lex0 union all
      select {n}, lower(n_name), lower(n_name), lower(n_name), 'profanity', 'high', 'stem', 'en', false from nation)"""


def part_lexicon() -> str:
    collapsed = collapse("string_split(term, '')")
    return f"""names as (select distinct lower(p_name) as term from part),
      said as (select unnest(string_split(term, ' ')) as term from names
        union all select w from (select unnest(regexp_split_to_array(lower(text), '[^\\p{{L}}]+')) as w from benchmark) where length(w) >= 13),
      kinds as (select term, ['stem', 'exact', 'legacy'][length(term) % 3 + 1] as kind from (select distinct term from said where term <> '')
        union all select term, 'phrase' from names),
      lex as materialized (select ('0x' || substr(md5(kind || term), 1, 7))::int as ord, term, term as folded, {collapsed} as collapsed,
        case kind when 'phrase' then 'harassment' else 'insult' end as category, 'medium' as severity, kind, 'en' as script, false as critical from kinds)"""


SQL = {
    "normalize_bundle": f"""with {bundle(DOCS)} select k as doc_id, {', '.join(f'md5({s}) as {s}' for s in STRINGS)},
      md5(array_to_string(list_sort(tokens), ' ')) as tokens,
      len(list_distinct([folded, leet, latin_arabic, lower(homoglyphs), letters_only])) as n_phonetic,
      len(list_distinct({COMPACTS})) as n_compact from bundle""",
    "char_ngrams": f"""with c as (select item_id, {compact('lower(text)')} as t from benchmark)
      select distinct item_id, substr(t, i::int, n::int) as gram from c, range(3, 6) r(n), lateral (select unnest(range(1, length(t) - n + 2)) as i)
      where length(t) >= n""",
    "content_fingerprint": f"""with a as (select 'documents' as origin, doc_id::varchar as id, text from documents
      union all select 'conversations', conv_id || '/' || turn, text from conversations),
      b as (select *, {hash_fold('text')} as ch from a), c as (select *, trim({cap('ch')}, {SPACES}) as f from b)
      select origin, id, case when f = '' then '' else sha256(f) end as plain_hash, sha256(f || '_' || id::varchar) as media_hash from c""",
    "escaped_cards": f"""with e as (select *, {escape('html')} as x from pages) select page_id, md5(x) as escaped,
      md5('<b>New question</b> from #' || page_id || chr(10) || x) as post_card,
      md5('<b>Reply</b> from #' || page_id || case when page_id <> 0 then ' to ' || page_id else '' end || chr(10) || x) as reply_card,
      case when length(html) > 0 then substr(html, 1, 150) else '[document]' end as preview from e""",
    "redact_text": f"select doc_id, md5({redacted('text')}) as redacted from documents",
    "link_scan": f"""with a as (select 'pages' as origin, page_id as id, html as text from pages union all select 'documents', doc_id, text from documents)
      select origin, id, {link('text')} as link, regexp_matches(text, {lit(R.NARROW_LINK)}) as plain_link from a""",
    "pii_scan": f"""select doc_id, {phone('text')} as phone, {email('text')} as email, {name('text')} as name, {age('text')} as age,
      null::varchar as place, {pii_category('text')} as category from documents""",
    "phrase_hits": f"""select doc_id, item_id from documents d, benchmark b where contains(lower(d.text), lower(b.text))""",
    "lexicon_hits": f"with {bundle(DOCS)}, {hits()} {HIT_ROWS.format(layers='0, 5, 6, 7')}",
    "table_lexicon": f"with {bundle(DOCS)}, {hits(part_lexicon())} {HIT_ROWS.format(layers='0, 5, 6, 7')}",
    "disguised_words": f"with {bundle(DOCS)}, {hits()} {HIT_ROWS.format(layers='3, 4')}",
    "custom_terms": f"with {complete(lexicon=custom_lexicon())} select k as doc_id, action, item from complete",
    "moderate_documents": f"with {complete()} select k as doc_id, * exclude (k), {MESSAGE} as message from complete",
    "moderate_open_links": f"""with {complete(off=('profanity', 'insult', 'bullying'), links=False)}
      select k as doc_id, action, category, rule_id from complete""",
    "verdict_reuse": f"with {complete()} select k as doc_id, action, category, rule_id, item from complete",
    "verdict_store": f"""select 'strict' as policy, k as id, action, category, rule_id, item, r.reused
      from (with {complete(f"select 'd/' || doc_id as k, text as raw from documents union all {ITEMS}")} select * from complete) c
      join (select 'd/' || doc_id as k, true as reused from documents union all select 'b/' || item_id, exists (
        select 1 from documents d where coalesce(d.text, '') = coalesce(b.text, '')) from benchmark b) r using (k)
      union all select 'open', k, action, category, rule_id, item, false
      from (with {complete(ITEMS, off=('profanity', 'insult', 'bullying'), links=False)} select * from complete)""",
    "moderation_eval": f"""with {complete()}, e as (select d.lang, l.toxic = 1 as want, not v.is_allowed as got from documents d
      join labels l using (doc_id) join complete v on v.k = d.doc_id), g as (select lang, count(*) as n, count(*) filter (want and got) as tp,
      count(*) filter (not want and got) as fp, count(*) filter (want and not got) as fn, count(*) filter (not want and not got) as tn from e group by lang)
      select *, round(tp / nullif(tp + fp, 0)::double, 6) as precision, round(tp / nullif(tp + fn, 0)::double, 6) as recall from g""",
    "noisy_recall": f"""with {complete(noisy(3))}, e as (select split_part(k, '/', 2)::int as seed, is_allowed from complete),
      g as (select seed, count(*) as n, count(*) filter (not is_allowed) as tp, 0 as fp, count(*) filter (is_allowed) as fn, 0 as tn from e group by seed)
      select *, case when tp > 0 then 1.0::double end as precision, round(tp / n::double, 6) as recall from g""",
    "profanity_test": f"""with f as (select doc_id, {hash_fold('text')} as ch from documents), g as (select doc_id, trim({cap('ch')}, {SPACES}) as t from f),
      h as (select *, replace(regexp_replace(t, '[^\\p{{L}}\\p{{N}}_\\s]', '', 'g'), ' ', '') as j from g), {lexicon_values()},
      m as (select doc_id, arg_min(l.term, l.ord) as word from (select *, {frame('t')} as f from h) h, lex l where {whole('f', 'l.folded')} or (length(l.folded) >= 4 and contains(j, l.folded)) group by doc_id)
      select h.doc_id, m.word from h left join m on h.doc_id = m.doc_id""",
    "fuzzy_tokens": _fuzzy(("idiot", "moron", "clown", "loser")),
    "signal_fusion": f"""with {SIGNALS}, r as (select *, row_number() over (partition by payload_id order by is_security desc, score desc, confidence desc, ordinal) as rn from counted),
      t as (select * from r where rn = 1), p as (select distinct payload_id from signals),
      d as (select p.payload_id, t.*  exclude (payload_id), case when t.payload_id is null then 'ALLOW' when is_security or score >= 3 then 'BLOCK' else 'REVIEW' end as action
        from p left join t using (payload_id))
      select payload_id, action <> 'BLOCK' as is_allowed, action, coalesce(category, 'none') as category, coalesce(severity, 'low') as severity,
        coalesce(confidence, 1.0) as confidence, case when is_security then case when contains(reason, 'unsupported') then 'unsupported' else 'failed' end else 'safe' end as status,
        detected_item from d""",
    "signal_reasons": f"""with {SIGNALS}, a as (select *, bool_or(is_security) over (partition by payload_id) as alarmed from counted)
      select payload_id, ordinal, '[' || source || '] ' || reason as reason,
      case when is_security then 'RULE_SECURITY_' || source else 'RULE_' || source || '_' || upper(category) end as rule_id from a where is_security or not alarmed""",
    "policy_filter": f"""with {SIGNALS} select p as policy_id, category, payload_id, ordinal from signals, (values ('strict'), ('open')) v(p)
      where not (p = 'open' and category in ('link', 'bullying'))""",
    # The swap distance cell by cell; a row all above the limit ends the count at limit + 1.
    "word_distances": f"""with recursive w as (select {words('lower(text)')} as w from benchmark),
      pairs as (select distinct w[i::int] as a, w[i::int + 1] as b from w, lateral (select unnest(range(1, len(w))) as i)),
      sized as (select *, length(a) as la, length(b) as lb, greatest(3, greatest(length(a), length(b)) // 3) as most from pairs),
      d as (
        select *, 1::bigint as i, 1::bigint as j, range(0, lb + 1) as older, range(0, lb + 1) as last, [1::bigint] as cur, false as cut1, false as cut from sized
        union all
        select a, b, la, lb, most, case when j = lb then i + 1 else i end, case when j = lb then 1 else j + 1 end,
          case when j = lb then last else older end, case when j = lb then list_append(cur, v) else last end,
          case when j = lb then [i + 1] else list_append(cur, v) end,
          cut1 or (j = lb and list_min(list_append(cur, v)) > 1), cut or (j = lb and list_min(list_append(cur, v)) > most)
        from (select *, least(last[j + 1] + 1, cur[j] + 1, last[j] + (substr(a, i, 1) <> substr(b, j, 1))::int,
          case when i > 1 and j > 1 and substr(a, i, 1) = substr(b, j - 1, 1) and substr(a, i - 1, 1) = substr(b, j, 1) then older[j - 1] + 1 end) as v
          from d where i <= la)),
      e as (select a, b, la, lb, most, cut1, cut, last[lb + 1] as v from d where i > la)
      select a, b, case when a = b then 0 when abs(la - lb) > 1 or cut1 then 2 else least(v, 2) end as distance,
        round(case when a = b then 1.0 else greatest(0.0, 1.0 - (case when abs(la - lb) > most or cut then most + 1 else v end) / greatest(la, lb)) end, 6) as similarity from e""",
    "sql_functions": f"""with b as (select doc_id, {hash_fold('text')} as ch from documents), c as (select *, trim({cap('ch')}, {SPACES}) as f from b)
      select doc_id, case when f = '' then '' else sha256(f) end as content, sha256(f || '_' || doc_id::varchar) as media from c""",
    "envelope_verdicts": f"""with {complete('''select id || '/' || part as k, body as raw from (
        select conv_id || '/' || turn as id, 0 as part, case when role <> 'user' then text end as body from conversations
        union all select conv_id || '/' || turn, 1, case when role = 'system' then text end from conversations
        union all select conv_id || '/' || turn, 2, case when role <> 'system' then text end from conversations) where coalesce(body, '') <> '' ''')},
      b as (select regexp_replace(k, '/[0-9]+$', '') as id, split_part(k, '/', 3)::int as part, category, item, confidence, case severity when 'critical' then 4 when 'high' then 3 when 'medium' then 2 else 1 end as score
        from complete where not is_allowed),
      t as (select *, row_number() over (partition by id order by score desc, confidence desc, part) as rn from b)
      select e.id, case when t.id is null then 'ALLOW' else 'BLOCK' end as action, coalesce(t.category, 'none') as category, t.item as detected_item
      from (select conv_id || '/' || turn as id from conversations) e left join t on e.id = t.id and t.rn = 1""",
    "publish_gate": f"""with a as (select doc_id, not regexp_matches(text, {lit(R.NARROW_LINK)}) as text_ok, coalesce(quality = 1, false) as media_ok
      from documents left join labels using (doc_id)) select *, text_ok and media_ok as published,
      case when not text_ok then 'text' when not media_ok then 'media' end as stopped_by from a""",
    # Equal to the swap distance unless letters are put between swapped ones.
    "fuzzy_tokens_long": _fuzzy_long(("worthless", "pathetic", "disgusting")),
    "moderate_fuzzy": f"with {complete()} select k as doc_id, * exclude (k) from complete",
}
