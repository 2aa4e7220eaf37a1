"""SQL that checks the registered queries, for DuckDB over the same tables.

Text rules are written a second time here, as SQL expressions built by small functions, and
queries as plain window SQL without any of the plans that the operators use.
"""

from __future__ import annotations

from unitflow.functions.text import (
    APOSTROPHES,
    DASHES,
    NO_BREAK_SPACE,
    QUOTES,
    WHITESPACE,
    WORD_MARK,
)
from unitflow.options import MIME_TYPES
from unitflow.plans.fixtures import FAULT, GAP_DOCS, LABEL, LABELS, NOISY_DOCS, RU_DOCS

RUS, ENG, UZB = "'rus_Cyrl'", "'eng_Latn'", "uzn_Latn"


def strip(x: str) -> str:
    return f"trim({x}, '{WHITESPACE}')"


def norm(x: str) -> str:
    """RE2 has no look-around: matched neighbours are put back, twice for overlapping matches."""
    source = (APOSTROPHES + QUOTES + DASHES + NO_BREAK_SPACE).replace("'", "''")
    target = "''" * len(APOSTROPHES) + '"' * len(QUOTES) + "-" * len(DASHES) + " "
    out = f"translate({x}, '{source}', '{target}')"
    for rule in ("([OoGg])[?]([A-Za-z''])", "([A-Za-z])[?]([A-Za-z])"):
        for _ in range(2):
            out = f"regexp_replace({out}, '{rule}', '\\1''\\2', 'g')"
    return out


def cyr(x: str) -> str:
    return f"length(regexp_replace({x}, '[^\\x{{0400}}-\\x{{04FF}}]', '', 'g'))"


def lat(x: str) -> str:
    return f"length(regexp_replace({x}, '[^A-Za-z]', '', 'g'))"


def source(x: str, detected: str | None = None) -> str:
    s = strip(x)
    c, a = cyr(s), lat(s)
    label = (
        f"when {detected} = 'ru' then {RUS} "
        f"when {detected} in ('en','uz','tr','de','fr','es','it') then {ENG} "
        if detected
        else ""
    )
    return (
        f"case when {s} = '' then {ENG} "
        f"when {c} > {a} * 1.2::double and {c} >= 3 then {RUS} "
        f"when length({s}) < 20 then case when {c} > {a} then {RUS} else {ENG} end "
        f"when not regexp_matches({s}, '\\p{{L}}') then case when {c} > {a} then {RUS} else {ENG} end "
        f"{label}"
        f"when {c} > {a} then {RUS} else {ENG} end"
    )


def stub(x: str, src: str = "src_lang") -> str:
    """The stub translator, blank in, blank out, normalised."""
    s = strip(x)
    return f"case when {s} = '' then '' else {norm(f'''concat('[', {src}, '>{UZB}] ', {s})''')} end"


def docs(expr: str = "text", more: str = "") -> str:
    return f"docs as (select doc_id, {expr} as text{more} from documents)"


LINES = """lines as (
  select d.*, i - 1 as i, ls[i] as t from (
    select *, string_split(text, chr(10)) as ls from docs) d,
    unnest(generate_series(1, len(ls))) as g(i))"""

UNITS = f"""units as (
  select doc_id, row_number() over (partition by doc_id order by i) - 1 as unit_idx, i, t
  from lines where {strip('t')} <> '')"""

LAYOUT = f"""flat as (
  select doc_id, i, sp, i // 8 as page,
    case when (doc_id + i) % 9 = 0 then 1 else 0 end as type,
    case when sp = 0 then substring(t, 1, length(t) // 2)
         else substring(t, length(t) // 2 + 1) end as text,
    (72 + 200 * sp)::double as x0, (50 + 16 * (i % 8))::double as y0,
    (252 + 200 * sp)::double as x1, (62 + 16 * (i % 8))::double as y1,
    (case when i % 5 = 0 then 11 else 7 + (i % 4) end)::double as size,
    (doc_id * 7919 + i * 104729) % 16777216 as color
  from lines, (values (0), (1)) s(sp)),
spans as (
  select *, row_number() over (partition by doc_id order by i, sp) - 1 as unit_idx
  from flat where type = 0 and {strip('text')} <> '')"""

SOURCED = f"sourced as (select *, {source('t')} as src_lang from units)"
VOTES = f"""votes as (
  select doc_id, sum((v = {RUS})::bigint)::bigint as votes_ru,
         sum((v = {ENG})::bigint)::bigint as votes_en
  from (select doc_id, {source('t')} as v from units where unit_idx < 50) group by doc_id),
voted as (
  select doc_id, case when votes_ru > votes_en then {RUS} else {ENG} end as src_lang,
         votes_ru, votes_en from votes)"""

RU_LINES = f"with {docs(RU_DOCS)}, {LINES}"
NOISY_LINES = f"with {docs(NOISY_DOCS)}, {LINES}"
GAP_LINES = f"with {docs(GAP_DOCS)}, {LINES}"
DOC_LINES = f"with {docs()}, {LINES}"
RU_UNITS = f"{RU_LINES}, {UNITS}"
GAP_UNITS = f"{GAP_LINES}, {UNITS}"
GAP_SPANS = f"{GAP_LINES}, {LAYOUT}"


def capacity(w: str, h: str, s: str) -> str:
    rows = f"greatest(1, trunc({h} / ({s} * 1.2::double))::bigint)"
    return f"greatest(1, trunc({w} * {rows} / ({s} * 0.5::double))::bigint)"


def fit(w: str, h: str, x: str, size: str, slack: str) -> str:
    steps = f"generate_series(0, trunc((greatest(4.0, {size}) - 4.0) / 0.5)::bigint)"
    sizes = f"list_transform({steps}, lambda k: greatest(4.0::double, {size}) - k * 0.5::double)"
    fits = f"length({x}) <= {capacity(w, h, 'z')} * {slack}::double"
    return f"coalesce(list_filter({sizes}, lambda z: {fits})[1], 4.0::double)"


def rgb(c: str) -> str:
    return (
        f"(({c} >> 16) & 255) / 255.0::double as r, (({c} >> 8) & 255) / 255.0::double as g, "
        f"({c} & 255) / 255.0::double as b"
    )


def marked(x: str) -> str:
    return f"concat('<', {strip(x)}, '>')"


CORPUS = f"""{RU_UNITS}, {VOTES},
done as (
  select l.doc_id, l.i, case when {strip('t')} = '' then t else {stub('t')} end as text
  from lines l join voted using (doc_id))
select doc_id, i // 4096 as part, count(*) as n_pieces,
       string_agg(text, chr(10) order by i) as text
from done group by doc_id, i // 4096"""

FILES = f"""files as (
  select doc_id, concat('in/', source, '/', case doc_id % 8
    when 0 then 'a.docx' when 1 then 'b.PDF' when 2 then 'c.v2.pdf' when 3 then 'd.txt'
    when 4 then 'plain' when 5 then '.pdf' when 6 then 'e.DocX' else 'f.tar.docx' end) as path,
    case (doc_id // 8) % 5 when 0 then 'auto' when 1 then 'docx' when 2 then 'PDF'
      when 3 then '' else 'odt' end as requested,
    case when doc_id % 11 = 0 then concat('out/', doc_id, '.final.tmp') end as out
  from documents),
named as (
  select *, case doc_id % 8 when 0 then '.docx' when 1 then '.pdf' when 2 then '.pdf'
      when 3 then '.txt' when 4 then '' when 5 then '' when 6 then '.docx' else '.docx' end as suffix,
    case doc_id % 8 when 0 then 'a' when 1 then 'b' when 2 then 'c.v2' when 3 then 'd'
      when 4 then 'plain' when 5 then '.pdf' when 6 then 'e' else 'f.tar' end as stem,
    case when requested in ('', 'auto') then 'auto' else lower(requested) end as wish
  from files),
reasons as (
  select *, suffix in ('.docx', '.pdf') as supported,
    case when suffix not in ('.docx', '.pdf') then 'unsupported input'
         when wish = 'odt' then 'unknown output format' end as reject_reason,
    case when wish = 'auto' then suffix[2:] else wish end as fmt
  from named),
manifest as (
  select doc_id, path, requested, out, suffix, supported,
    case when reject_reason is null then fmt end as out_format,
    case when reject_reason is null then
      case when out is not null then concat('out/', doc_id, '.final.', fmt)
           else concat(path[:length(path) - length(parse_filename(path))], stem, '_uz.', fmt) end
      end as out_path,
    case when reject_reason is null then
      case fmt when 'pdf' then '{MIME_TYPES["pdf"]}' else '{MIME_TYPES["docx"]}' end end as mime,
    reject_reason
  from reasons)"""

GRAMS = f"""{docs(RU_DOCS, f', {LABEL} as lang')}, {LINES}, {UNITS.replace('i, t', 'i, t, lang')},
grams as (
  select doc_id, unit_idx, lang, unnest(flatten(list_transform([1, 2, 3], lambda n:
    list_transform(generate_series(1, length(t) - n + 1), lambda k: substring(t, k, n))))) as gram
  from units),
counts as (
  select gram, {', '.join(f"count(*) filter (lang = '{x}') as n_{x}" for x in LABELS)}
  from grams group by gram),
totals as (
  select count(*) as v, {', '.join(f'sum(n_{x}) as t_{x}' for x in LABELS)} from counts),
profile as (
  select gram, {', '.join(
      f'round(ln((n_{x} + 1) / (t_{x} + v)::double) * 1000000)::bigint as {x}' for x in LABELS)}
  from counts, totals),
sums as (
  select doc_id, unit_idx, any_value(lang) as lang, {', '.join(
      f'sum({x})::bigint as {x}' for x in LABELS)}
  from grams join profile using (gram) group by doc_id, unit_idx),
labels as (
  select doc_id, unit_idx, lang, case greatest({', '.join(LABELS)})
    {' '.join(f"when {x} then '{x}'" for x in LABELS)} end as label from sums)"""

HELD_OUT = GRAMS.replace("from grams group by gram", "from grams where doc_id % 5 <> 0 group by gram")
OPENED = f"""opened as (
  select doc_id, unit_idx, t, case when length({strip('t')}) >= 20
    and not ({cyr('t')} > {lat('t')} * 1.2::double and {cyr('t')} >= 3)
    and regexp_matches(t, '\\p{{L}}') then label end as detected
  from units join labels using (doc_id, unit_idx))"""
DETECTED = f"""{GRAMS}, {OPENED},
votes as (
  select doc_id, sum((v = {RUS})::bigint)::bigint as votes_ru,
         sum((v = {ENG})::bigint)::bigint as votes_en
  from (select doc_id, {source('t', 'detected')} as v from opened where unit_idx < 50) group by doc_id),
voted as (
  select doc_id, case when votes_ru > votes_en then {RUS} else {ENG} end as src_lang,
         votes_ru, votes_en from votes)"""

PAGES = f"""{GAP_SPANS},
first_images as (
  select doc_id, page, xref, i, y0, w, h from (
    select *, row_number() over (partition by doc_id, page, xref order by i) as rn from (
      select doc_id, i // 8 as page, i, (doc_id + i // 9) % 5 as xref,
             (50 + 16 * (i % 8))::double as y0, 4 + (i % 3) * 8 as w, 20 as h
      from lines where (doc_id + i) % 9 = 0) where xref <> 0) where rn = 1),
items as (
  select doc_id, page, y0 as y, 0 as rank, unit_idx as ord, {strip(norm(marked('text')))} as payload
  from spans
  union all
  select doc_id, page, y0, 1, i, concat('[image ', xref, ']') from first_images
  where w >= 8 and h >= 8),
spine as (
  select doc_id, unnest(generate_series(0, max(i) // 8)) as page from lines group by doc_id)
select s.doc_id, s.page, 0::bigint as part, s.page > 0 as break_before,
  count(payload) as n_items,
  concat_ws(chr(10), concat('Sahifa ', s.page + 1),
            string_agg(payload, chr(10) order by y, rank, ord)) as text
from spine s left join items using (doc_id, page) group by s.doc_id, s.page"""

SPAN_PAGES = f"""{RU_LINES}, {LAYOUT},
votes as (
  select doc_id, sum((v = {RUS})::bigint) as ru, sum((v = {ENG})::bigint) as en
  from (select doc_id, {source('text')} as v from spans where unit_idx < 50) group by doc_id),
items as (
  select doc_id, page, y0, unit_idx, {stub('text', f"case when ru > en then {RUS} else {ENG} end")}
    as payload from spans join votes using (doc_id)),
spine as (
  select doc_id, unnest(generate_series(0, max(i) // 8)) as page from lines group by doc_id)
select s.doc_id, s.page, count(payload) as n_items,
  concat_ws(chr(10), concat('Sahifa ', s.page + 1),
            string_agg(payload, chr(10) order by y0, unit_idx)) as text
from spine s left join items using (doc_id, page) group by s.doc_id, s.page"""

PLAN = f"""{GAP_SPANS},
boxes as (
  select doc_id, page, unit_idx, x0, y0, x1, greatest(y1, y0 + size * 1.35::double) as y1, size,
         color, {strip(norm(marked('text')))} as text from spans),
fitted as (
  select *, {fit('(x1 - x0)', '(y1 - y0)', 'text', 'size', '1.2')} as font_size from boxes),
plan as (
  select doc_id, page, unit_idx, x0, y0, x1, y1, size, font_size, {rgb('color')},
    font_size < greatest(4.0, size) as shrunk,
    length(text) > {capacity('(x1 - x0)', '(y1 - y0)', '4.0::double')} * 1.2::double as overflow,
    text from fitted)"""

FIT_W = "(20 + (doc_id * 31 + i * 17) % 500)::double"
FIT_H = "(6 + (doc_id + i * 7) % 60)::double"
FIT_S = "(2 + (i % 40) * 0.75)::double"

RUNS = """paras as (
  select doc_id, i, t, case when i % 5 = 4 then []::varchar[]
    when i % 4 = 0 then list_concat([''], string_split(t, ', '))
    else string_split(t, ', ') end as runs from lines)"""


def placed(new: str) -> str:
    """Runs with ``new`` in the first run that has text, or the first, as SQL."""
    at = "coalesce(list_position(list_transform(runs, lambda r: r <> ''), true), 1)"
    put = (
        f"list_transform(generate_series(1, len(runs)), lambda k: "
        f"case when k = {at} then {new} else '' end)"
    )
    return (
        f"case when len(runs) > 0 then {put} "
        f"when {new} <> '' then [{new}] else []::varchar[] end"
    )


NEW_RUN = "case when i % 7 = 6 then '' else concat('<', i, '>') end"

JUDGED = f"""{RU_UNITS}, {SOURCED},
judged as (
  select *, case unit_idx % 6 when 0 then '' when 1 then t when 2 then concat('«', t)
    when 3 then null else concat('Salom ', t) end as translated from sourced)"""
GOOD = f"{strip('''coalesce(translated, '')''')} <> ''"

BATCHED = f"""{RU_UNITS}, {SOURCED},
ranked as (
  select *, row_number() over (partition by doc_id, src_lang order by unit_idx) - 1 as k,
    count(*) over (partition by doc_id, src_lang) as n,
    count(*) over (partition by doc_id) as total,
    min(unit_idx) over (partition by doc_id, src_lang) as first_idx from sourced)"""

ORACLES: dict[str, str] = {
    "strip_ws": f"""{DOC_LINES}
        select doc_id, i, {strip(f'''concat(substring('{WHITESPACE}', i % 29 + 1, 1), t,
          substring('{WHITESPACE}', doc_id % 29 + 1, 1))''')} as stripped from lines""",
    "normalize_uz": f"{NOISY_LINES} select doc_id, i, {norm('t')} as normalized from lines",
    "script_counts": f"{RU_LINES} select doc_id, i, {cyr('t')} as cyr, {lat('t')} as lat from lines",
    "detect_source": f"{RU_LINES} select doc_id, i, {source('t')} as src_lang from lines",
    "effective_source": f"""{RU_LINES} select doc_id, i, {source('t')} as auto_source,
        {RUS} as pinned_source from lines""",
    "final_text": f"""{NOISY_LINES} select doc_id, i, {norm('''case i % 3 when 0 then t
        when 1 then t else concat('[', t, ']') end''')} as final from lines""",
    "paragraph_text": f"""{DOC_LINES}, {RUNS}
        select doc_id, i as para_idx, coalesce(array_to_string(runs, ''), '') as text from paras""",
    "replace_runs": f"""{DOC_LINES}, {RUNS}
        select doc_id, i as para_idx, len({placed(NEW_RUN)}) as n_runs,
          coalesce(array_to_string({placed(NEW_RUN)}, '|'), '') as runs from paras""",
    "tokens_to_text": f"""{NOISY_LINES} select doc_id, i,
        {norm(strip(f'''concat(case when i % 4 = 3 then ' eng_' else '' end,
          ' ', replace(t, '{WORD_MARK}', ' '))'''))} as text from lines""",
    "loc_path": f"""{DOC_LINES}, steps as (
        select doc_id, i, concat('_r', i % 3, 'c', i % 2,
            case when i % 5 = 0 then concat('_n1_r2c', doc_id % 4) else '' end, 'p', i % 10) as cell,
          case i % 4 when 2 then concat('header', doc_id % 3) else concat('footer', doc_id % 3) end as h
        from lines)
        select doc_id, i, case when i % 4 = 0 then 'body'
          when i % 4 = 1 then concat('table', i % 6, cell)
          when i % 8 > 3 then concat(h, '_t', i % 6, cell) else h end as loc from steps""",
    "unpack_rgb": f"{GAP_SPANS} select doc_id, unit_idx, {rgb('color')} from spans",
    "fit_font_size": f"""{DOC_LINES} select doc_id, i,
        {fit(FIT_W, FIT_H, 't', FIT_S, '1.2')} as font_size,
        {fit(FIT_W, FIT_H, 't', FIT_S, '1.15')} as font_size_strict from lines""",
    "explode_paragraphs": f"""{GAP_UNITS} select doc_id, unit_idx, concat('docx-', i) as uid,
        'docx_para' as kind, 'body' as loc, i as para_idx, t as text from units""",
    "explode_spans": f"""{GAP_SPANS} select doc_id, unit_idx, concat('pdf-', unit_idx) as uid,
        'pdf_span' as kind, page, x0, y0, x1, y1, size, color, text from spans""",
    "read_lines": f"""with {docs(GAP_DOCS, ', source')}, {LINES}
        select source, count(*) as n_lines, sum(length(t))::bigint as n_chars, true as gapless
        from lines where {strip('t')} <> '' group by source""",
    "read_docx": f"""with {docs('text', ', lang, source')}, {LINES},
        sizes as (select doc_id, any_value(lang) as lang, any_value(source) as source,
                         count(*) as n from lines group by doc_id),
        paras as (
          select doc_id, i as para_idx, 'body' as loc, t as text from lines
          union all select doc_id, n, 'table0_r0c0p0', lang from sizes
          union all select doc_id, n + 1, 'table0_r0c1p0', doc_id::varchar from sizes
          union all select doc_id, n + 2, 'header0', source from sizes
          union all select doc_id, n + 3, 'footer0', '' from sizes)
        select doc_id, para_idx, loc, case when loc = 'footer0' then 0 else 1 end::bigint as n_runs,
          text from paras""",
    "plan_manifest": f"with {FILES} select * from manifest",
    "route_writer": f"""with {FILES}, routed as (
        select *, case when reject_reason is null then case concat(suffix, '>', out_format)
          when '.docx>docx' then 'replace_paragraphs' when '.pdf>docx' then 'rebuild_pages'
          when '.pdf>pdf' then 'replace_spans' else 'paginate_lines' end end as writer
        from manifest)
        select writer, reject_reason, count(*) as n from routed group by all""",
    "side_by_side": f"""{RU_UNITS}, {SOURCED}
        select doc_id, unit_idx, concat(t, chr(9), '→', chr(9), {stub('t')}) as value
        from sourced""",
    "sink_roundtrip": f"""select *, case doc_id % 2 when 0 then 'docx' else 'pdf' end as out_format
        from ({CORPUS})""",
    "translate_files": f"""{GAP_SPANS}, {RUNS}, {FILES},
        routed as (select doc_id, reject_reason, concat(suffix, '>', out_format) as r from manifest),
        texts as (select *, {strip("coalesce(array_to_string(runs, ''), '')")} <> '' as filled
          from paras),
        has_text as (
          select doc_id from texts join routed using (doc_id) where filled and r like '.docx%'
          union select doc_id from spans join routed using (doc_id) where r like '.pdf%'),
        results as (
          select 'replace_paragraphs' as writer, doc_id from texts join routed using (doc_id)
          where r = '.docx>docx' and doc_id in (select doc_id from has_text)
          union all select 'paginate_lines', doc_id from texts join routed using (doc_id)
          where r = '.docx>pdf' and filled
          union all select 'rebuild_pages', doc_id from (select distinct doc_id, i // 8 as page
            from lines) join routed using (doc_id)
          where r = '.pdf>docx' and doc_id in (select doc_id from has_text)
          union all select 'replace_spans', doc_id from spans join routed using (doc_id)
          where r = '.pdf>pdf'
          union all select 'rejected', doc_id from routed
          where reject_reason is not null or doc_id not in (select doc_id from has_text))
        select writer, count(distinct doc_id) as n_docs, count(*) as n_rows
        from results group by writer""",
    "translate_folder": f"""with {docs(RU_DOCS, ', lang, source')}, {LINES},
        sizes as (select doc_id, any_value(lang) as lang, any_value(source) as source,
                         count(*) as n from lines group by doc_id),
        paras as (
          select doc_id, i as para_idx, t from lines
          union all select doc_id, n, lang from sizes
          union all select doc_id, n + 1, doc_id::varchar from sizes
          union all select doc_id, n + 2, source from sizes
          union all select doc_id, n + 3, '' from sizes),
        kept as (select *, row_number() over (partition by doc_id order by para_idx) - 1 as unit_idx
          from paras where {strip('t')} <> ''),
        votes as (select doc_id, sum((v = {RUS})::int) as ru, sum((v = {ENG})::int) as en from (
          select doc_id, {source('t')} as v from kept where unit_idx < 50) group by doc_id),
        voted as (select doc_id, case when ru > en then {RUS} else {ENG} end as src_lang from votes),
        counted as (
          select doc_id, any_value(src_lang) as src_lang, count(*) as n_paras,
            sum(({strip('t')} <> '')::int) as n_units,
            sum(length(case when {strip('t')} = '' then t else {stub('t')} end)) as n_chars
          from paras join voted using (doc_id) group by doc_id),
        told as (select *, case doc_id % 50 when 0 then 'unsupported input' when 1 then 'no reader for its pages'
          when 2 then 'damaged' end as reason from counted)
        select doc_id, case when reason is null then 'translated' else 'rejected' end as status, reason,
          case when reason is null then src_lang end as src_lang,
          (case when reason is null then n_paras when reason = 'damaged' then 0 end)::bigint as n_paras,
          (case when reason is null then n_units end)::bigint as n_units,
          (case when reason is null then n_chars end)::bigint as n_chars from told""",
    "document_outcomes": f"""{RU_UNITS}, {VOTES},
        counted as (select doc_id, count(*) as n from lines group by doc_id)
        select doc_id, case when doc_id % 5 <> 0 then src_lang end as src_lang,
          case when doc_id % 5 = 0 then 0 else (n + 15) // 16 end::bigint as n_parts,
          case when doc_id % 5 = 0 then 'no text' end as reject_reason
        from counted join voted using (doc_id)""",
    "translate_remembered": f"""{RU_UNITS}, {SOURCED}
        select doc_id, unit_idx, src_lang, {stub('t')} as translated from sourced""",
    "memory_growth": f"""{RU_UNITS}, {SOURCED},
        texts as (select src_lang, {strip('t')} as s, bool_or(doc_id % 2 = 0) as half from sourced group by all)
        select case when half then 'half' else 'all' end as batch, count(*) as n_texts from texts group by all""",
    "reject_sources": f"""{DOC_LINES}, coded as (
        select case (doc_id + i) % 4 when 0 then {ENG} when 1 then {RUS}
          when 2 then 'deu_Latn' end as src_lang from lines)
        select case when src_lang in ({ENG}, {RUS}) then 'ok' else 'rejected' end as status,
          src_lang, count(*) as n from coded group by all""",
    "document_source": f"{RU_UNITS}, {VOTES} select doc_id, src_lang, votes_ru, votes_en from voted",
    "document_source_in_row": f"""{RU_UNITS}, {VOTES}
        select doc_id, coalesce(src_lang, {ENG}) as src_lang from docs left join voted using (doc_id)""",
    "file_source": f"""{RU_UNITS}, heads as (
        select doc_id, string_agg(t, ' ' order by unit_idx) as t from units
        where unit_idx < 5 group by doc_id)
        select doc_id, {source('t')} as src_lang from heads""",
    "empty_documents": f"""select doc_id from documents
        where doc_id % 5 = 0 or {strip('text')} = ''""",
    "language_groups": f"""{RU_UNITS}, {SOURCED}
        select doc_id, src_lang, count(*) as n_units, min(unit_idx) as first_idx
        from sourced group by doc_id, src_lang""",
    "train_profiles": f"""with {GRAMS}
        {' union all '.join(f"select '{x}' as lang, gram, {x} as logp from profile" for x in LABELS)}""",
    "classify_accuracy": f"""with {GRAMS}
        select lang, label, count(*) as n from labels group by lang, label""",
    "held_out_accuracy": f"""with {HELD_OUT}
        select lang, label, count(*) as n from labels where doc_id % 5 = 0 group by lang, label""",
    "detect_with_profiles": f"""with {GRAMS}, {OPENED}
        select doc_id, unit_idx, detected, {source('t', 'detected')} as src_lang from opened""",
    "detect_units": f"""with {GRAMS}, {OPENED}
        select doc_id, unit_idx, {source('t', 'detected')} as src_lang from opened""",
    "document_source_detected": f"""with {DETECTED}
        select doc_id, src_lang, src_lang as by_units, votes_ru, votes_en from voted""",
    "file_source_detected": f"""with {GRAMS}, heads as (
          select doc_id, string_agg(t, ' ' order by unit_idx) as t from units
          where unit_idx < 5 group by doc_id),
        head_sums as (
          select doc_id, {', '.join(f'sum({x})::bigint as {x}' for x in LABELS)} from (
            select doc_id, unnest(flatten(list_transform([1, 2, 3], lambda n: list_transform(
              generate_series(1, length(t) - n + 1), lambda k: substring(t, k, n))))) as gram from heads)
          join profile using (gram) group by doc_id),
        told as (
          select doc_id, t, case when length({strip('t')}) >= 20
            and not ({cyr('t')} > {lat('t')} * 1.2::double and {cyr('t')} >= 3)
            and regexp_matches(t, '\\p{{L}}') then case greatest({', '.join(LABELS)})
            {' '.join(f"when {x} then '{x}'" for x in LABELS)} end end as detected
          from heads join head_sums using (doc_id))
        select doc_id, {source('t', 'detected')} as src_lang from told""",
    "translate_corpus_detected": f"""with {DETECTED},
        done as (
          select l.doc_id, l.i, case when {strip('t')} = '' then t else {stub('t')} end as text
          from lines l join voted using (doc_id))
        select doc_id, i // 4096 as part, count(*) as n_pieces,
          string_agg(text, chr(10) order by i) as text
        from done group by doc_id, i // 4096""",
    "translate_units": f"""{NOISY_LINES}, {UNITS}, {SOURCED}
        select doc_id, unit_idx, src_lang, {stub('t')} as translated,
          length({strip('t')}) > 200 as over_limit from sourced""",
    "translate_distinct": f"""{RU_UNITS}, {SOURCED}
        select doc_id, unit_idx, src_lang, {stub('t')} as translated from sourced""",
    "translate_staged": f"""{RU_UNITS}, {SOURCED}
        select doc_id, unit_idx, src_lang, {stub('t')} as translated from sourced""",
    "translate_long": f"""{NOISY_LINES}, {UNITS}, {SOURCED},
        cut as (select *, {strip('t')} as s, case when length({strip('t')}) <= 60 then [{strip('t')}]
          else regexp_extract_all({strip('t')}, '(?s).{{1,60}}\\z|.{{0,58}}[.!?…][{WHITESPACE}]|.{{0,59}}[{WHITESPACE}]|.{{1,60}}') end as p
          from sourced),
        done as (select *, array_to_string(list_transform(p, lambda g: case when {strip('g')} = '' then g else
          concat(left(g, length(g) - length(ltrim(g, '{WHITESPACE}'))), '[', src_lang, '>{UZB}] ', {strip('g')},
            right(g, length(g) - length(rtrim(g, '{WHITESPACE}')))) end), '') as out from cut)
        select doc_id, unit_idx, src_lang, {norm('out')} as translated, len(p)::int as n_segments from done""",
    "translate_faulty": f"""{DOC_LINES}, {UNITS}, {SOURCED}
        select doc_id, unit_idx, case when contains(t, '{FAULT}') then '' else {stub('t')} end as translated,
          case when contains(t, '{FAULT}') then 'ValueError: cannot translate' end as error from sourced""",
    "translate_with": f"""{GAP_LINES} select doc_id, i, case when {strip('t')} = '' then t
        else {norm('''concat('<', t, '>')''')} end as translated from lines""",
    "translate_text": f"""with sourced as (
        select conv_id, turn, text as t, {source("coalesce(text, '')")} as src_lang from conversations)
        select conv_id, turn, src_lang, {stub("coalesce(t, '')")} as translated from sourced""",
    "translate_corpus": CORPUS,
    "translate_corpus_per_unit": f"""{GAP_LINES}, sourced as (
          select *, {source('t')} as src_lang from lines),
        done as (select doc_id, i, case when {strip('t')} = '' then t else {stub('t')} end as text
          from sourced)
        select doc_id, i // 4096 as part, count(*) as n_pieces,
          string_agg(text, chr(10) order by i) as text from done group by all""",
    "translate_lines": f"""{RU_UNITS}, heads as (
          select doc_id, string_agg(t, ' ' order by unit_idx) as head from units
          where unit_idx < 5 group by doc_id),
        sourced as (select u.*, {source('head')} as src_lang from units u join heads using (doc_id))
        select doc_id, unit_idx as line_idx, src_lang, {stub('t')} as translated from sourced""",
    "write_back": f"""{GAP_LINES}, {RUNS},
        texts as (select *, array_to_string(runs, '') as pt from paras),
        done as (select *, {norm(marked('pt'))} as new from texts),
        placed as (select doc_id, i, case when {strip("coalesce(pt, '')")} = '' then runs
          else {placed('new')} end as runs from done)
        select doc_id, i as para_idx, len(runs) as n_runs,
          coalesce(array_to_string(runs, '|'), '') as runs from placed""",
    "assemble_document": f"""{GAP_UNITS}
        select doc_id, unit_idx // 4096 as part, count(*) as n_pieces,
          string_agg({marked('t')}, chr(10) order by unit_idx) as text from units
        group by doc_id, unit_idx // 4096""",
    "page_images": f"""{GAP_LINES}, listed as (
          select doc_id, i // 8 as page, i * 3 + k as img_idx, (doc_id + i + k) % 5 as xref,
            (50 + 16 * (i % 8))::double as y0, 4 + ((i + k) % 3) * 8 as width, 20 as height
          from lines, (values (0), (1), (2)) s(k)),
        first as (select *, row_number() over (partition by doc_id, page, xref order by img_idx) as rn
          from listed where xref <> 0)
        select doc_id, page, img_idx, xref, y0, width, height from first
        where rn = 1 and width >= 8 and height >= 8""",
    "assemble_pages": PAGES,
    "layout_to_pages": SPAN_PAGES,
    "layout_plan": f"{PLAN} select * from plan where text <> ''",
    "overflow_report": f"""{PLAN} select doc_id, page, count(*) as n_spans,
        count(*) filter (shrunk) as n_shrunk, count(*) filter (font_size = 4) as n_least,
        count(*) filter (overflow) as n_overflow from plan group by doc_id, page""",
    "paginate": f"""{GAP_UNITS}, kept as (
          select doc_id, unit_idx, {norm(marked('t'))} as x,
            row_number() over (partition by doc_id order by unit_idx) - 1 as k from units)
        select doc_id, unit_idx, k // 44 as page_no, 50 + 16 * (k % 44) as y,
          substring(x, 1, 500) as line, substring(x, 501) as rest, greatest(length(x) - 500, 0) as cut_chars from kept""",
    "head_n": f"""{DOC_LINES}, {UNITS}
        select doc_id, unit_idx, t as text from units where unit_idx < 5""",
    "preview": f"""{GAP_UNITS} select doc_id, unit_idx + 1 as row_no, substring(t, 1, 200) as text,
        substring({marked('t')}, 1, 200) as translated from units where unit_idx < 80""",
    "plan_batches": f"""{BATCHED}
        select doc_id, unit_idx, src_lang, k // 8 as batch_no, k % 8 as pos from ranked""",
    "progress": f"""{BATCHED}, batches as (
          select doc_id, src_lang, k // 8 as batch_no, count(*) as n, any_value(first_idx) as f,
            any_value(total) as total from ranked group by doc_id, src_lang, k // 8),
        running as (
          select *, row_number() over w as step, sum(n) over w as done from batches
          window w as (partition by doc_id order by f, batch_no rows unbounded preceding))
        select doc_id, step, src_lang, batch_no, done::bigint as done, total,
          concat('Tarjima: ', done, '/', total) as message from running""",
    "unit_counts": f"{GAP_UNITS} select doc_id, count(*) as n_units from units group by doc_id",
    "page_load": f"""{GAP_SPANS} select doc_id, page, count(*) as n_units,
        sum(length(text))::bigint as n_chars from spans group by doc_id, page""",
    "quality_report": f"""{JUDGED} select src_lang, count(*) as total,
        count(*) filter ({GOOD}) as translated, count(*) filter (not ({GOOD})) as empty,
        count(*) filter (translated = t) as unchanged,
        count(*) filter ({norm('translated')} <> translated) as unnormalised,
        count(*) filter ({GOOD}) / count(*)::double as share from judged group by src_lang""",
    "checks": f"""{JUDGED},
        ranked as (select *, (row_number() over (partition by doc_id, src_lang order by unit_idx) - 1)
          // 4 as b from judged),
        batches as (select bool_and({GOOD}) as ok from ranked group by doc_id, src_lang, b)
        select 'non_empty' as rule, count(*) filter ({GOOD}) as passed,
          count(*) filter (not ({GOOD})) as failed from judged
        union all select 'greets', count(*) filter (h), count(*) filter (not h) from (
          select contains(lower(coalesce(translated, '')), 'salom')
              or contains(lower(coalesce(translated, '')), 'qanday') as h from judged)
        union all select 'same_count', least(count(t), count(translated)),
          abs(count(t) - count(translated)) from judged
        union all select 'whole_batch', count(*) filter (ok), count(*) filter (not ok) from batches""",
    "checks_observed": f"""{JUDGED}
        select 'non_empty' as rule, count(*) filter ({GOOD}) as passed,
          count(*) filter (not ({GOOD})) as failed from judged
        union all select 'greets', count(*) filter (h), count(*) filter (not h) from (
          select contains(lower(coalesce(translated, '')), 'salom')
              or contains(lower(coalesce(translated, '')), 'qanday') as h from judged)
        union all select 'same_count', least(count(t), count(translated)),
          abs(count(t) - count(translated)) from judged""",
    "stream_lines": f"""{RU_LINES}, sourced as (
          select *, {source('t')} as src_lang from lines where {strip('t')} <> '')
        select doc_id, i as para_idx, src_lang, {stub('t')} as translated from sourced""",
    "stream_docs": CORPUS,
    "stream_layout": f"select *, 'complete' as status from ({SPAN_PAGES})",
}
