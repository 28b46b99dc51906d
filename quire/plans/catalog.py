"""The queries of the core: each as a plan over the driver's tables, with SQL where SQL says the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quire.functions import columns as K
from quire.operators import cleaning, edits, findings, inspection, layout, post, words
from quire.operators import lines as L
from quire.operators import tables as T
from quire.plans import finish, grading
from quire.sources import shared
from quire.sources import tables as S
from quire.streaming import events as E

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

DOCS = "recursive docs as (select result_id, any_value(body) as body, any_value(pages) as pages from ocr_results where result_id is not null group by result_id)"
RAW = DOCS + """, split as (select result_id, string_split(body, chr(10)) as a from docs where body is not null),
raw as materialized (select result_id, unnest(a) as line, generate_subscripts(a, 1) - 1 as line_no from split)"""
OPENS = "(m.sign <> '' and not (m.sign[1] = '`' and contains(m.info, '`')))"
LINES = RAW + f""", front as (select result_id, min(line_no) as front_end from raw r where line = '---' and line_no > 0
  and exists (select 1 from raw f where f.result_id = r.result_id and f.line_no = 0 and f.line = '---') group by result_id),
marked as materialized (select r.*, coalesce(f.front_end, -1) as front_end, regexp_extract(line, '^ {{0,3}}(`{{3,}}|~{{3,}})', 1) as sign, trim(regexp_replace(line, '^ {{0,3}}(`{{3,}}|~{{3,}})', '')) as info,
  contains(lower(line), '<table') as tabled, len(regexp_extract_all(lower(line), '<table')) - len(regexp_extract_all(lower(line), '</table>')) as opened from raw r left join front f using (result_id)),
state(result_id, line_no, fence, depth, protected) as (select result_id, front_end, '', 0, true from (select distinct result_id, front_end from marked) union all
  select m.result_id, m.line_no, case when s.fence <> '' then case when m.sign <> '' and m.sign[1] = s.fence[1] and length(m.sign) >= length(s.fence) and m.info = '' then '' else s.fence end when {OPENS} then m.sign else '' end,
  case when s.fence <> '' or {OPENS} then s.depth else greatest(0, s.depth + m.opened) end, s.fence <> '' or {OPENS} or s.depth > 0 or m.tabled or m.opened <> 0
  from state s join marked m on m.result_id = s.result_id and m.line_no = s.line_no + 1),
zoned0 as (select m.result_id, m.line_no, m.line, m.line_no <= m.front_end or coalesce(s.protected, true) as protected from marked m left join state s on s.result_id = m.result_id and s.line_no = m.line_no),
counted as (select *, case when protected then 0 else len(regexp_extract_all(line, '\\$\\$')) end as dollars, case when protected then '' else line end as own,
  case when regexp_matches(line, '^<!-- source:page (\\d+) -->$') then regexp_extract(line, '^<!-- source:page (\\d+) -->$', 1)::int end as mark from zoned0),
lines as (select result_id, line_no, line, protected, dollars > 0 or (sum(dollars) over w - dollars) % 2 = 1 as display,
  last_value(mark ignore nulls) over (partition by result_id order by line_no rows unbounded preceding) as page,
  not protected and regexp_matches(trim(line), '^(=+|-+)$') and regexp_matches(lag(own, 1, '') over w, '[\\p{{L}}\\p{{N}}]') and not regexp_matches(lag(own, 1, '') over w, '^ {{0,3}}#{{1,6}}[ \\t]+\\S') as underline
  from counted window w as (partition by result_id order by line_no))"""
HEADS = LINES + """, heads0 as (select *, length(regexp_extract(line, '^ {0,3}(#{1,6})', 1)) as level, trim(regexp_replace(line, '^ {0,3}#{1,6}[ \\t]*', '')) as title, regexp_matches(line, '^ {0,3}#{1,6}[^#\\s]') as glued
  from lines where not protected and regexp_matches(line, '^ {0,3}#{1,6}([ \\t]+\\S|[^#\\s])')),
heads as (select *, lag(level) over (partition by result_id order by line_no) as previous from heads0)"""
JUNK = "not protected and length(c) >= 2 and not regexp_matches(c, '[\\p{L}\\p{N}]') and not (underline or regexp_matches(c, '^(- *){3,}$|^(\\* *){3,}$|^(_ *){3,}$') or regexp_matches(c, '^[|:\\- \\t]*-[|:\\- \\t]*$') or c = '$$' or regexp_matches(c, '^(\\\\\\\\)+$'))"
REPEATS = """, may as (select result_id, trim(line) as core, line_no from lines where not protected and regexp_matches(line, '[\\p{L}\\p{N}]') and length(trim(line)) <= 80
  and not regexp_matches(line, '^ {0,3}#{1,6}[ \\t]+\\S') and not contains(regexp_replace(regexp_replace(trim(line), '`[^`]*`', '', 'g'), '\\\\\\|', '', 'g'), '|') and not regexp_matches(trim(line), '(?i)^(</?figure[^<>]*>|<img[^<>]*>)$')
  and regexp_replace(trim(line), '\\$\\$[^$]+\\$\\$|\\$[^$]+\\$', '', 'g') <> '' and not (not regexp_matches(trim(line), '\\s') and length(trim(line)) <= 3) and not regexp_matches(line, '^<!-- source:page (\\d+) -->$')),
gaps as (select *, line_no - lag(line_no) over (partition by result_id, core order by line_no) as gap from may),
groups as (select result_id, core, count(*) as copies, median(gap)::double as median_gap, greatest(3.0::double, any_value(n) / 1000) as least from gaps join (select result_id, count(*) as n from lines group by result_id) using (result_id)
  group by result_id, core having count(*) >= 3 and median(gap) <= 3)"""
PROSE = LINES + """, prose as (select result_id, line_no, regexp_replace(regexp_replace(regexp_replace(line, '`[^`]*`', ' ', 'g'), '\\]\\([^()\\s]*\\)', '] ', 'g'), '(https?://|www\\.)\\S+|\\S+@\\S+', ' ', 'g') as prose
  from lines where not protected and not display and not starts_with(line, '<!--')),
words as (select result_id, word, count(*) as n from (select result_id, unnest(regexp_extract_all(lower(prose), '\\p{L}+')) as word from prose) group by all)"""
ROWS = LINES + """, isrow as (select *, (not protected and regexp_matches(line, '^\\s*\\|.*\\|\\s*$')) as is_row from lines),
runs as (select *, row_number() over w - sum(is_row::int) over w as table_id from isrow window w as (partition by result_id order by line_no)),
numbered as (select result_id, table_id, line_no, row_number() over (partition by result_id, table_id order by line_no) as row_no,
  regexp_matches(line, '^[|:\\- \\t]*-[|:\\- \\t]*$') as is_rule,
  [trim(c, ' ') for c in string_split(regexp_replace(regexp_replace(line, '^\\s*\\|', ''), '\\|\\s*$', ''), '|')] as cells from runs where is_row),
rows as (select * from (select *, bool_or(is_rule and row_no = 2) over (partition by result_id, table_id) as ruled from numbered) where ruled),
cells0 as (select result_id, table_id, row_no, unnest(cells) as cell, generate_subscripts(cells, 1) - 1 as col_no from rows where not is_rule)"""
BLOCKS = "blocks as (select * from (select *, row_number() over (partition by block_key order by ingested_at) as rn from block_outputs) where rn = 1)"
BOXED = BLOCKS + ", boxed as (select *, list_min([p[1] for p in polygon]) as x0, list_min([p[2] for p in polygon]) as y0, list_max([p[1] for p in polygon]) as x1, list_max([p[2] for p in polygon]) as y1 from blocks)"
TEXT = r"trim(replace(replace(replace(replace(replace(replace(regexp_replace(html, '<[^>]*>', '', 'g'), '&lt;', '<'), '&gt;', '>'), '&quot;', '\"'), '&#39;', ''''), '&nbsp;', ' '), '&amp;', '&'))".replace('\\"', '"')


def query(name: str, sql: str | None = None, exact: bool = False):
    """Registers a query; in its SQL a doubled backslash is a single one, unless it is exact."""

    def add(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql if exact else sql.replace("\\\\", "\\")
        return f

    return add


def zoned(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.zoned(S.bodies(spark, sf_dir))



FOLD = "trim(lower(regexp_replace(regexp_replace({0}, '^\\d+(\\.\\d+)*\\.?\\s+', ''), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g')))"
SHORT = "(not protected and trim(line) <> '' and length(line) <= 25 and not regexp_matches(line, '^\\s*([-*+]|\\d{1,9}[.)])[ \\t]+\\S') and not regexp_matches(line, '^ {0,3}#{1,6}[ \\t]+\\S') and not contains(line, '|') and not contains(line, '$') and not regexp_matches(line, '^[<!\\[]'))"
TABLE_ROW = "(not protected and regexp_matches(line, '^\\s*\\|.*\\|\\s*$'))"
ENTRY_SQL = "'" + grading.ENTRY + "'"


def sql_count(text: str, rule: str) -> str:
    return f"len(regexp_extract_all({text}, '{rule}'))"


def valid_sql(x: str) -> str:
    pairs = f"{sql_count(x, '[{]')} - {sql_count(x, '[\\\\][{]')} = {sql_count(x, '[}]')} - {sql_count(x, '[\\\\][}]')}"
    return f"trim({x}) <> '' and {pairs} and {sql_count(x, '[\\\\]left[^A-Za-z]')} = {sql_count(x, '[\\\\]right[^A-Za-z]')} and {sql_count(x, '[\\\\]begin[{]')} = {sql_count(x, '[\\\\]end[{]')}"


def kept_letters(rule: str) -> str:
    return f"length(regexp_replace(body, '[^{rule}]', '', 'g'))"


MEASURES = HEADS + REPEATS + f""",
seen as (select l.*, trim(line) as c, lead(line) over w as nxt, lead(protected) over w as nxt_p, {SHORT} as short, {TABLE_ROW} as is_row from lines l window w as (partition by result_id order by line_no)),
base as (select result_id, count(*) as lines, count(*) filter (where c <> '') as filled, sum(length(line) + 1)::bigint as chars, sum(length(regexp_replace(line, '[^\\p{{L}}\\p{{N}}]', '', 'g')))::bigint as alnum,
  count(*) filter (where c <> '' and {JUNK}) as junk, count(*) filter (where is_row) as table_rows,
  count(*) filter (where not protected and not display and not nxt_p and regexp_matches(line, '\\p{{L}}-\\s*$') and regexp_matches(nxt, '^\\s*\\p{{Ll}}')) as hyphens,
  count(*) filter (where regexp_matches(line, '^\\[page (\\d+) not recognized\\]$')) as lost, coalesce(string_agg(line, chr(10) order by line_no) filter (where not protected), '') as text,
  coalesce(sum({sql_count('line', grading.GREEK_UNIT)} - {sql_count('line', grading.KNOWN_UNIT)}) filter (where not protected and regexp_matches(regexp_replace(line, '\\$\\$[^$]+\\$\\$|\\$[^$]+\\$', '', 'g'), '\\p{{Cyrillic}}')), 0)::bigint as greek_units from seen group by result_id),
hs as (select result_id, count(*) as headings, count(*) filter (where glued or level > previous + 1) as jumps from heads group by result_id),
depths as (select result_id, level, case when regexp_matches(title, '^\\d+(\\.\\d+)*\\.?\\s+') then len(regexp_extract_all(regexp_extract(title, '^([\\d.]+)', 1), '\\d+')) else 0 end as depth from heads),
per_level as (select result_id, level, count(*) as n, row_number() over (partition by result_id order by count(*) desc, level) as r, sum(count(*)) over (partition by result_id) as of_all from depths group by result_id, level),
known as (select result_id, count(distinct depth) as kinds, min(depth) as least from depths where depth > 0 group by result_id),
ladder as (select d.result_id, count(*) filter (where d.level = p.level and d.depth > k.least) as flat_ladder from depths d join per_level p on p.result_id = d.result_id and r = 1 join known k on k.result_id = d.result_id where of_all >= 3 and 3 * n > 2 * of_all and kinds >= 2 group by d.result_id),
unders as (select l.result_id, l.line, l.protected, last_value(case when h.level is not null then {FOLD.format('h.title')} end ignore nulls) over (partition by l.result_id order by l.line_no rows unbounded preceding) as under from lines l left join heads h on h.result_id = l.result_id and h.line_no = l.line_no),
entries as (select distinct result_id, {FOLD.format(f"regexp_extract(line, {ENTRY_SQL}, 2)")} as title from unders where not protected and under in {grading.CONTENTS} and regexp_matches(line, {ENTRY_SQL})),
chaps as (select e.result_id, count(*) as chapters, count(*) filter (where not exists (select 1 from heads h where h.result_id = e.result_id and {FOLD.format('h.title')} = e.title)) as lost_chapters from entries e group by e.result_id),
runs0 as (select *, row_number() over w - sum(short::int) over w as run, row_number() over w - sum(is_row::int) over w as tab from seen window w as (partition by result_id order by line_no)),
flat as (select result_id, count(*) as flat_runs from (select result_id, run from runs0 where short group by result_id, run having count(*) >= 6) group by result_id),
trow as (select result_id, tab, row_number() over (partition by result_id, tab order by line_no) as k, len(string_split(replace(regexp_replace(regexp_replace(line, '^\\s*\\|', ''), '\\|\\s*$', ''), '\\|', '!'), '|')) as n, regexp_matches(line, '^[|:\\- \\t]*-[|:\\- \\t]*$') as is_rule from runs0 where is_row),
twide as (select *, max(case when k = 2 and is_rule then n end) over (partition by result_id, tab) as width from trow),
tfit as (select *, max((k <> 2 and n = width)::int) over (partition by result_id, tab) as fits from twide),
broken as (select result_id, count(*) as broken_rows from tfit where width is not null and fits = 1 and n <> width group by result_id),
rep as (select result_id, count(*) filter (where copies >= least) as repeat_groups, max(copies) filter (where copies >= least) as most_copies from groups group by result_id),
plain as (select result_id, text, regexp_replace(replace(text, '\\$', '  '), '`[^`\\n]*`', '', 'g') as bare from base),
found as (select *, regexp_extract_all(bare, '\\$\\$([^$]*)\\$\\$', 1) as display, regexp_extract_all(regexp_replace(bare, '\\$\\$[^$]*\\$\\$', ' ', 'g'), '\\$([^$\\s][^$\\n]*)\\$', 1) as inline from plain),
math as (select result_id, len(display) + len(inline) as formulas, len(list_filter(list_concat(display, inline), lambda x: not ({valid_sql('x')}))) as bad_formulas, {sql_count('bare', '[$][$]')} as display_signs,
  len(list_filter(display, lambda x: regexp_matches(x, '{grading.STRUCTURE}') or length(x) > 3000 or len(string_split(x, chr(10))) > 40)) as runaway, {kept_letters('\\p{Latin}')} as latin, {kept_letters('\\p{Cyrillic}')} as cyrillic, {kept_letters('\\p{Greek}')} as greek,
  {kept_letters('\\p{Han}\\p{Hiragana}\\p{Katakana}\\p{Hangul}')} as cjk, {kept_letters('\\p{L}')} as letters, {kept_letters(grading.ACCENTED)} as accented, {kept_letters(grading.IMPOSSIBLE)} as impossible from found join docs using (result_id)),
measures as (select b.result_id, pages, lines, filled, chars, alnum, coalesce(headings, 0) as headings, coalesce(jumps, 0) as jumps, junk, table_rows, coalesce(broken_rows, 0) as broken_rows, hyphens, coalesce(flat_runs, 0) as flat_runs, lost, greek_units,
  coalesce(repeat_groups, 0) as repeat_groups, coalesce(most_copies, 0)::bigint as most_copies, coalesce(flat_ladder, 0) as flat_ladder, coalesce(chapters, 0) as chapters, coalesce(lost_chapters, 0) as lost_chapters, formulas, bad_formulas, display_signs, runaway,
  letters + impossible as sample, greatest(0, letters - case when latin = greatest(latin, cyrillic, greek, cjk) then latin + cyrillic else greatest(latin, cyrillic, greek, cjk) + latin end) + impossible as unreadable, letters, accented, cyrillic
  from base b join docs using (result_id) join math using (result_id) left join hs using (result_id) left join ladder using (result_id) left join chaps using (result_id) left join flat using (result_id) left join broken using (result_id) left join rep using (result_id))"""


def counted_sql(column: str, floor: float, rate: float) -> str:
    return f"greatest(0.0, {column} - {floor}) / greatest({float(floor)}::double, {float(rate)} * lines / 1000.0)"


def check_rows(undone: str) -> str:
    rows = {
        "text_density": ("0", "coalesce(pages > 0 and chars - 1 < 350 * pages, false)"), "empty_body": ("0", "alnum < 20"),
        "unreadable_chars": ("case when sample >= 200 then unreadable / sample / 0.15 else 0 end", "sample >= 200 and cyrillic >= 0.05::double * letters and accented > 0.15::double * letters"),
        "formulas": (counted_sql("bad_formulas", 2, 1), "false"), "runaway_math": ("0", "display_signs % 2 = 1 or runaway > 0"), "greek_units": ("greek_units", "false"),
        "headings": (counted_sql("jumps", 1, 2), "false"), "flat_ladder": (counted_sql("flat_ladder", 0, 2), "false"), "lost_chapters": ("greatest(0, lost_chapters - 1) / greatest(1.0::double, chapters / 4)", "false"),
        "tables": (counted_sql("broken_rows", 0, 1), "false"), "junk_lines": ("junk / greatest(filled, 1) / 0.02::double", "false"),
        "repeats": (counted_sql("repeat_groups", 0, 1), "most_copies > 10 * greatest(3.0::double, lines / 1000)"), "hyphenation": (counted_sql("hyphens", 2, 2), "false"), "flattened_blocks": (counted_sql("flat_runs", 2, 2), "false"),
        "lost_pages": ("0", "lost > 0"), "inspection_coverage": (f"coalesce({undone} / 0.5::double, 0)", f"coalesce({undone} > 0.5, false)"),
    }
    return ", ".join(f"{{'at': {k}, 'name': '{n}', 'halvings': ({rows[n][0]})::double, 'veto': {rows[n][1]}}}" for k, n in enumerate(grading.CHECKS))


LAST = "last as (select * from (select *, row_number() over (partition by result_id order by ingested_at desc) as r from result_headers) where r = 1)"
#: Share of the chunks that an inspection left undone, as its header says it.
UNDONE = "(1 - try_cast(regexp_extract(inspection, 'partial \\((\\d+)/(\\d+)\\)', 1) as double) / try_cast(regexp_extract(inspection, 'partial \\((\\d+)/(\\d+)\\)', 2) as double))"
GRADE_SQL = f"""with {MEASURES}, {LAST}, m as (select measures.*, {UNDONE} as undone from measures left join last on last.result_id = measures.result_id),
checked as (select result_id, unnest([{check_rows('undone')}]) as k from m),
sums as (select result_id, sum(k.halvings) as s, bool_or(k.veto) as veto, coalesce(string_agg(k.name, ',' order by k.at) filter (where k.veto or 100 * pow(2, -k.halvings) < 50), '') as issues from checked group by result_id)
select result_id, case when veto then 0 else round_even(100 * pow(2, -s), 1) end::double as score, case when not veto and 100 * pow(2, -s) >= 50 then 'ok' else 'bad' end as status, issues from sums"""


@query("grade_documents", GRADE_SQL, True)
def grade_documents(spark, sf_dir):
    """Every body graded; the inspection of its header tells how many chunks were left undone."""
    part = lambda k: F.try_element_at(F.split(F.regexp_extract("inspection", r"partial \((\d+/\d+)\)", 1), "/"), F.lit(k)).try_cast("int")
    heads = S.headers(spark, sf_dir).select("result_id", part(2).alias("chunks"), part(1).alias("done"))
    out = grading.grade(S.bodies(spark, sf_dir).join(heads, "result_id", "left"))
    return out.select("result_id", "score", "status", F.array_join("issues", ",").alias("issues"))


MEASURED = "result_id lines filled chars alnum headings jumps junk table_rows broken_rows hyphens flat_runs lost greek_units repeat_groups most_copies flat_ladder chapters lost_chapters formulas bad_formulas display_signs runaway sample unreadable".split()


@query("body_measures", f"with {MEASURES} select {', '.join(MEASURED)} from measures", True)
def body_measures(spark, sf_dir):
    return grading.measures(S.bodies(spark, sf_dir)).select(*MEASURED)


@query("md_lines", f"with {RAW} select result_id, count(*) as lines, count(*) filter (where trim(line) = '') as blank, max(length(line)) as longest from raw group by result_id")
def md_lines(spark, sf_dir):
    lines = L.explode_lines(S.bodies(spark, sf_dir))
    return lines.groupBy("result_id").agg(F.count("*").alias("lines"), F.count(F.when(F.trim("line") == "", 1)).alias("blank"), F.max(F.length("line")).cast("long").alias("longest"))


@query("line_zones", f"with {LINES} select result_id, count(*) filter (where protected) as protected_lines, count(*) filter (where display) as display_lines from lines group by result_id")
def line_zones(spark, sf_dir):
    return zoned(spark, sf_dir).groupBy("result_id").agg(F.count(F.when(F.col("protected"), 1)).alias("protected_lines"), F.count(F.when(F.col("display"), 1)).alias("display_lines"))


@query("page_map", f"with {LINES} select result_id, page, count(*) as lines, min(line_no)::bigint as first_line from lines group by result_id, page")
def page_map(spark, sf_dir):
    return zoned(spark, sf_dir).groupBy("result_id", "page").agg(F.count("*").alias("lines"), F.min("line_no").cast("long").alias("first_line"))


@query("block_sizes", f"with {LINES}, p as (select *, (trim(line) <> '' and not protected) as plain from lines), q as (select *, plain and not coalesce(lag(plain) over (partition by result_id order by line_no), false) as first from p), r as (select *, sum(first::int) over (partition by result_id order by line_no) as block_id from q) select result_id, block_id::bigint as block_id, count(*) as lines from r where plain group by result_id, block_id")
def block_sizes(spark, sf_dir):
    return L.with_blocks(zoned(spark, sf_dir)).where("block_id is not null").groupBy("result_id", "block_id").agg(F.count("*").alias("lines"))


@query("noise_stripped", f"with {RAW} select result_id, count(*) as changed_lines from raw where regexp_replace(regexp_replace(line, '[­​-‍﻿]', '', 'g'), '[ \\t]+$', '') <> line group by result_id")
def noise_stripped(spark, sf_dir):
    lines = L.explode_lines(S.bodies(spark, sf_dir))
    return lines.where(K.without_noise(F.col("line")) != F.col("line")).groupBy("result_id").agg(F.count("*").alias("changed_lines"))


@query("junk_lines", f"with {LINES}, core as (select *, trim(line) as c from lines) select result_id, line_no::int as line_no from core where {JUNK}", True)
def junk_lines(spark, sf_dir):
    return zoned(spark, sf_dir).where(~F.col("protected") & K.is_junk(F.col("line"), F.col("underline"))).select("result_id", "line_no")


@query("repeat_groups", f"with {LINES}{REPEATS} select result_id, core as line, copies, median_gap from groups where copies >= least", True)
def repeat_groups(spark, sf_dir):
    return L.repeat_groups(zoned(spark, sf_dir)).select("result_id", "line", "copies", "median_gap")


@query("repeated_line_runs", f"with {LINES}, l as (select * from lines where not protected), f as (select *, (line is distinct from lag(line) over w or lag(line_no) over w is distinct from line_no - 1) as fresh from l window w as (partition by result_id order by line_no)), r as (select *, sum(fresh::int) over (partition by result_id order by line_no) as run_id from f) select result_id, min(line) as line, min(line_no)::int as first_line, count(*) as copies from r where trim(line) <> '' and not regexp_matches(line, '^\\s*\\|.*\\|\\s*$') group by result_id, run_id having count(*) >= 3")
def repeated_line_runs(spark, sf_dir):
    return L.repeated_runs(zoned(spark, sf_dir))


@query("repeated_blocks", f"with {LINES}, p as (select *, (trim(line) <> '' and not protected) as plain from lines), q as (select *, plain and not coalesce(lag(plain) over (partition by result_id order by line_no), false) as first from p), r as (select *, sum(first::int) over (partition by result_id order by line_no) as block_id from q), b as (select result_id, block_id, string_agg(line, chr(10) order by line_no) as text from r where plain group by result_id, block_id), f as (select *, text is distinct from lag(text) over (partition by result_id order by block_id) as fresh from b), g as (select *, sum(fresh::int) over (partition by result_id order by block_id) as run_id from f) select result_id, min(block_id)::bigint as first_block, count(*) as copies from g group by result_id, run_id having count(*) >= 3")
def repeated_blocks(spark, sf_dir):
    return L.repeated_blocks(L.with_blocks(zoned(spark, sf_dir)))


@query("flattened_runs", f"with {LINES}, s as (select *, (not protected and trim(line) <> '' and length(line) <= 25 and not regexp_matches(line, '^\\s*([-*+]|\\d{{1,9}}[.)])[ \\t]+\\S') and not regexp_matches(line, '^ {{0,3}}#{{1,6}}[ \\t]+\\S') and not contains(line, '|') and not contains(line, '$') and not regexp_matches(line, '^[<!\\[]')) as short from lines), r as (select *, row_number() over w - sum(short::int) over w as run_id from s window w as (partition by result_id order by line_no)) select result_id, min(line_no)::int as first_line, count(*) as run_lines from r where short group by result_id, run_id having count(*) >= 6")
def flattened_runs(spark, sf_dir):
    return L.flattened_runs(zoned(spark, sf_dir))


@query("hyphenations", f"with {LINES}, n as (select *, lead(line) over w as nxt, lead(protected) over w as nxt_p from lines window w as (partition by result_id order by line_no)) select result_id, line_no::int as line_no, regexp_extract(line, '(\\p{{L}}+)-\\s*$', 1) as head, regexp_extract(nxt, '^\\s*(\\p{{L}}+)', 1) as tail from n where not protected and not display and not nxt_p and regexp_matches(line, '\\p{{L}}-\\s*$') and regexp_matches(nxt, '^\\s*\\p{{Ll}}')")
def hyphenations(spark, sf_dir):
    return L.hyphenations(zoned(spark, sf_dir))


@query("attested_joins", f"with {PROSE}, n as (select *, lead(line) over w as nxt, lead(protected) over w as nxt_p from lines window w as (partition by result_id order by line_no)), h as (select result_id, line_no, regexp_extract(line, '(\\p{{L}}+)-\\s*$', 1) as head, regexp_extract(nxt, '^\\s*(\\p{{L}}+)', 1) as tail from n where not protected and not display and not nxt_p and regexp_matches(line, '\\p{{L}}-\\s*$') and regexp_matches(nxt, '^\\s*\\p{{Ll}}')) select result_id, line_no::int as line_no, lower(head || tail) as word from h where exists (select 1 from words w where w.result_id = h.result_id and w.word = lower(head || tail) and w.n >= 2)")
def attested_joins(spark, sf_dir):
    z = zoned(spark, sf_dir)
    return words.attested_joins(L.hyphenations(z), words.word_counts(z)).select("result_id", "line_no", "word")


@query("word_counts", f"with {PROSE} select * from words")
def word_counts(spark, sf_dir):
    return words.word_counts(zoned(spark, sf_dir))


@query("near_words", f"with {PROSE}, k as (select *, unnest([substr(word, 1, i - 1) || '*' || substr(word, i + 1) for i in range(1, length(word) + 1)]) as key from words where length(word) >= 6), pairs as (select r.result_id, r.word, o.word as neighbour from k r join k o on r.result_id = o.result_id and r.key = o.key where r.n = 1 and o.n >= 20) select result_id, word, min(neighbour) as neighbour from pairs group by result_id, word having count(distinct neighbour) = 1")
def near_words(spark, sf_dir):
    return words.near_words(words.word_counts(zoned(spark, sf_dir)))


@query("compound_hyphens", f"with {PROSE}, h as (select result_id, form, count(*) as broken_n, replace(form, '-', '') as joined from (select result_id, unnest(regexp_extract_all(lower(prose), '\\p{{L}}+-\\p{{L}}+')) as form from prose) group by result_id, form), o as (select result_id, joined, min(form) as form, sum(broken_n)::bigint as broken_n from h group by result_id, joined having count(*) = 1) select o.result_id, joined, form, broken_n, w.n as joined_n, case when w.n >= 3 * broken_n then 'join' when broken_n >= 3 * w.n then 'break' else 'leave' end as decision from o join words w on w.result_id = o.result_id and w.word = o.joined")
def compound_hyphens(spark, sf_dir):
    return words.compounds(zoned(spark, sf_dir))


@query("source_coverage", f"with {PROSE}, t as (select result_id, unnest(texts) as t from (select check_id, any_value(result_id) as result_id, any_value(texts) as texts from ocr_error_checks where texts is not null group by check_id)), there as (select distinct result_id, unnest(regexp_extract_all(lower(t), '\\p{{L}}+')) as word from t where t is not null) select w.result_id, round(sum(case when h.word is not null then n else 0 end) / sum(n), 6)::double as share from words w left join there h on h.result_id = w.result_id and h.word = w.word group by w.result_id")
def source_coverage(spark, sf_dir):
    z = zoned(spark, sf_dir)
    checks = S.table(spark, sf_dir, "ocr_error_checks").where("texts is not null").dropDuplicates(["check_id"])
    there = checks.select("result_id", F.explode("texts").alias("t")).where("t is not null").select("result_id", F.explode(F.regexp_extract_all(F.lower("t"), F.lit(r"(\p{L}+)"), 1)).alias("word")).distinct()
    return words.coverage(words.word_counts(z), there).select("result_id", F.round("share", 6).alias("share"))


@query("heading_levels", f"with {HEADS} select result_id, level::int as level, count(*) as headings from heads group by result_id, level")
def heading_levels(spark, sf_dir):
    return L.headings(zoned(spark, sf_dir)).groupBy("result_id", "level").agg(F.count("*").alias("headings"))


@query("heading_jumps", f"with {HEADS} select result_id, line_no::int as line_no, level::int as level, previous::int as previous, title from heads where level > previous + 1")
def heading_jumps(spark, sf_dir):
    return L.headings(zoned(spark, sf_dir)).where("level > previous + 1").select("result_id", "line_no", "level", "previous", "title")


@query("headings_off_mode", f"with {HEADS}, c as (select result_id, lower(title) as key, level, count(*) as n from heads group by all), m as (select result_id, key, level as usual, sum(n) over (partition by result_id, key) as copies, row_number() over (partition by result_id, key order by n desc, level) as r from c) select h.result_id, h.line_no::int as line_no, h.level::int as level, m.usual::int as usual from heads h join m on m.result_id = h.result_id and m.key = lower(h.title) and r = 1 and copies >= 2 where h.level <> m.usual")
def headings_off_mode(spark, sf_dir):
    return L.off_mode(L.headings(zoned(spark, sf_dir)))


@query("section_parents", f"with {HEADS} select h.result_id, h.line_no::int as line_no, h.level::int as level, (select max(p.line_no) from heads p where p.result_id = h.result_id and p.line_no < h.line_no and p.level < h.level)::int as parent from heads h")
def section_parents(spark, sf_dir):
    return L.section_path(L.headings(zoned(spark, sf_dir))).select("result_id", "line_no", "level", "parent")


@query("table_shapes", f"with {ROWS}, w as (select *, max(case when row_no = 2 then len(cells) end) over (partition by result_id, table_id) as width from rows) select result_id, table_id::bigint as table_id, width::int as width, count(*) filter (where row_no > 2) as body_rows, count(*) filter (where len(cells) <> width) as odd_rows from w group by result_id, table_id, width")
def table_shapes(spark, sf_dir):
    return T.shapes(T.rows(zoned(spark, sf_dir)))


@query("column_forms", f"with {ROWS} select result_id, table_id::bigint as table_id, col_no::int as col_no, count(distinct case when cell <> '' then regexp_replace(regexp_replace(cell, '\\p{{N}}+', '9', 'g'), '\\p{{L}}+', 'A', 'g') end) as forms, count(*) filter (where cell <> '') as filled from cells0 where row_no > 2 group by result_id, table_id, col_no")
def column_forms(spark, sf_dir):
    return T.column_forms(T.cells(T.rows(zoned(spark, sf_dir)))).select("result_id", "table_id", "col_no", F.size("forms").cast("long").alias("forms"), "filled")


@query("empty_columns", f"with {ROWS} select result_id, table_id::bigint as table_id, col_no::int as col_no from cells0 group by result_id, table_id, col_no having max(length(cell)) = 0")
def empty_columns(spark, sf_dir):
    return T.empty_columns(T.cells(T.rows(zoned(spark, sf_dir))))


@query("split_tables", f"with {ROWS}, t as (select result_id, table_id, min(line_no) as line_no, max(line_no) as last_line, list_aggregate(arg_min(cells, row_no), 'string_agg', '|') as head from rows group by result_id, table_id), n as (select *, lag(head) over w as before, lag(last_line) over w as before_last from t window w as (partition by result_id order by line_no)) select result_id, line_no::int as line_no, before_last::int as previous_line from n where head = before and not exists (select 1 from lines l where l.result_id = n.result_id and l.line_no > before_last and l.line_no < n.line_no and trim(l.line) <> '' and not regexp_matches(l.line, '^<!-- source:page (\\d+) -->$'))")
def split_tables(spark, sf_dir):
    z = zoned(spark, sf_dir)
    return T.split_tables(T.rows(z), z)


@query("padded_tables", f"with {ROWS}, w as (select *, max(length(cell)) over (partition by result_id, table_id, col_no) as width from cells0), r as (select result_id, table_id, row_no, 1 + sum(width + 3) as total, string_agg(cell, ' | ' order by col_no) as narrow, string_agg(rpad(cell, width::int, ' '), ' | ' order by col_no) as wide from w group by result_id, table_id, row_no) select result_id, table_id::bigint as table_id, row_no::int as row_no, '| ' || case when total <= 120 then wide else narrow end || ' |' as line from r")
def padded_tables(spark, sf_dir):
    return T.padded(T.cells(T.rows(zoned(spark, sf_dir))))


@query("repeated_images", f"with {LINES} select result_id, target, count(*) as placed from (select result_id, unnest(regexp_extract_all(line, '!\\[([^\\]\\n]*)\\]\\(([^()\\s]*)\\)', 2)) as target from lines where not protected) group by result_id, target")
def repeated_images(spark, sf_dir):
    z = zoned(spark, sf_dir).where(~F.col("protected"))
    return z.select("result_id", F.explode(F.regexp_extract_all("line", F.lit(K.IMAGE), 2)).alias("target")).groupBy("result_id", "target").agg(F.count("*").alias("placed"))


@query("script_shares", f"with {DOCS} select result_id, length(regexp_replace(body, '[^a-zA-Z]', '', 'g'))::bigint as latin, length(regexp_replace(body, '[^Ѐ-ӿ]', '', 'g'))::bigint as cyrillic, length(regexp_replace(body, '[^Ͱ-Ͽ]', '', 'g'))::bigint as greek, length(regexp_replace(body, '[^�]', '', 'g'))::bigint as impossible from docs where body is not null")
def script_shares(spark, sf_dir):
    n = lambda rule: F.length(F.regexp_replace("body", rule, "")).cast("long")
    return S.bodies(spark, sf_dir).where("body is not null").select("result_id", n("[^a-zA-Z]").alias("latin"), n("[^Ѐ-ӿ]").alias("cyrillic"), n("[^Ͱ-Ͽ]").alias("greek"), n("[^�]").alias("impossible"))


@query("math_spans", f"with {LINES} select result_id, sum(len(regexp_extract_all(line, '\\$[^$\\s][^$\\n]*\\$')))::bigint as inline_spans, sum(len(regexp_extract_all(line, '\\$\\$')))::bigint as display_signs from lines where not protected group by result_id")
def math_spans(spark, sf_dir):
    z = zoned(spark, sf_dir).where(~F.col("protected"))
    return z.groupBy("result_id").agg(F.sum(F.regexp_count("line", F.lit(r"\$[^$\s][^$\n]*\$"))).alias("inline_spans"), F.sum(F.regexp_count("line", F.lit(r"\$\$"))).alias("display_signs"))


@query("lost_pages", f"with {RAW} select result_id, regexp_extract(line, '^\\[page (\\d+) not recognized\\]$', 1)::int as page from raw where regexp_matches(line, '^\\[page (\\d+) not recognized\\]$')")
def lost_pages(spark, sf_dir):
    lines = L.explode_lines(S.bodies(spark, sf_dir))
    return lines.where(F.col("line").rlike(K.LOST_PAGE)).select("result_id", F.regexp_extract("line", K.LOST_PAGE, 1).cast("int").alias("page"))


FIXED = "regexp_replace(regexp_replace(line, '[­​-‍﻿]', '', 'g'), '[ \\t]+$', '')"
for rule, new in (
    (r"!\[[^\]\n]*[\w-]\.(png|jpe?g|gif|svg|tiff?|webp|bmp)\]\(", "![]("), (r"\*\*(\p{L}+)\*\*(\p{L})", r"\1\2"), (r"(\p{L})\*\*(\p{L}+)\*\*", r"\1\2"), (r"^(\d+)\. (\d+)\.(\s)", r"\1.\2.\3"),
    (r"<span id=[^<>]*></span>", ""), (r"([^!]|^)\[([^\]\n]+)\]\(#[^()\s]*\)", r"\1\2"), (r"^( {0,3}#{1,6}[ \t]+)\*\*([^*]+)\*\*[ \t]*$", r"\1\2"),
):
    FIXED = f"regexp_replace({FIXED}, '{rule}', '{new}', 'g')"
LINE_FIXES_SQL = f"""with {LINES}, f as (select result_id, line_no, line, {FIXED} as x from lines where not protected),
g as (select *, case when regexp_matches(x, '^ {{0,3}}#{{1,6}}[ \\t]+\\S') and length(x) > 200 then trim(regexp_replace(x, '^ {{0,3}}#{{1,6}}[ \\t]*', '')) else x end as y from f),
h as (select *, regexp_replace(regexp_replace(y, '^( {{0,3}})•[ \\t]+(\\S)', '\\1- \\2'), '^(\\s*[-*+] \\*\\*\\d+[.)]\\*\\*)(\\S)', '\\1 \\2') as fixed from g) select result_id, line_no::int as line_no, fixed from h where fixed <> line"""


@query("line_fixes", LINE_FIXES_SQL, True)
def line_fixes(spark, sf_dir):
    z = zoned(spark, sf_dir).where(~F.col("protected"))
    fixed = F.col("line")
    for fix in K.LINE_FIXES:
        fixed = fix(fixed)
    return z.withColumn("fixed", fixed).where("fixed <> line").select("result_id", "line_no", "fixed")


@query("clean_markdown")
def clean_markdown(spark, sf_dir):
    return cleaning.clean(S.bodies(spark, sf_dir))


@query("finished_results")
def finished_results(spark, sf_dir):
    return finish.finished(S.bodies(spark, sf_dir), S.headers(spark, sf_dir))


@query("clean_grades")
def clean_grades(spark, sf_dir):
    b = S.bodies(spark, sf_dir)
    cleaned = cleaning.clean(b).select("result_id", F.col("clean").alias("body")).join(b.select("result_id", "pages"), "result_id")
    return grading.grade(cleaned)


@query(
    "structure_differences",
    f"with {ROWS}, mine as (select l.result_id, count(*) filter (where not protected and regexp_matches(line, '^ {{0,3}}#{{1,6}}[ \\t]+\\S')) as headings, coalesce(sum(len(regexp_extract_all(line, '!\\[([^\\]\\n]*)\\]\\(([^()\\s]*)\\)'))) filter (where not protected), 0)::bigint as images from lines l group by l.result_id), t as (select result_id, count(distinct table_id) as tables from rows group by result_id), s as (select result_id, case when headings_by_level is not null then coalesce(list_sum(map_values(headings_by_level)), 0) end::bigint as stated_headings, table_count::bigint as stated_tables, image_count::bigint as stated_images from structure_counts) select s.result_id, headings, stated_headings, images, stated_images, coalesce(tables, 0) as tables, stated_tables from s join mine using (result_id) left join t using (result_id) where headings is distinct from stated_headings or images is distinct from stated_images or coalesce(tables, 0) is distinct from stated_tables",
)
def structure_differences(spark, sf_dir):
    """Counts written in the table beside those of the bodies, where they differ or aren't stated."""
    z = zoned(spark, sf_dir)
    plain = ~F.col("protected")
    mine = z.groupBy("result_id").agg(F.count(F.when(plain & F.col("line").rlike(K.HEADING), 1)).alias("headings"), F.coalesce(F.sum(F.when(plain, F.regexp_count("line", F.lit(K.IMAGE)))), F.lit(0)).alias("images"))
    tables = T.rows(z).groupBy("result_id").agg(F.countDistinct("table_id").alias("tables"))
    heads = F.when(F.col("headings_by_level").isNotNull(), F.aggregate(F.map_values("headings_by_level"), F.lit(0), lambda a, x: a + F.coalesce(x, F.lit(0)))).cast("long")
    stated = S.table(spark, sf_dir, "structure_counts").select("result_id", heads.alias("stated_headings"), F.col("table_count").cast("long").alias("stated_tables"), F.col("image_count").cast("long").alias("stated_images"))
    both = stated.join(mine, "result_id").join(tables, "result_id", "left").na.fill(0, ["tables"])
    return both.where(~F.col("headings").eqNullSafe(F.col("stated_headings")) | ~F.col("images").eqNullSafe(F.col("stated_images")) | ~F.col("tables").eqNullSafe(F.col("stated_tables"))).select("result_id", "headings", "stated_headings", "images", "stated_images", "tables", "stated_tables")


@query("reading_order", f"with {BOXED} select result_id, page_id, block_key, row_number() over (partition by result_id, page_id order by case block_type when 'PageHeader' then 0 when 'Footnote' then 2 when 'PageFooter' then 3 else 1 end, round(y0 / 1.25), x0, block_id)::int as place from boxed")
def reading_order(spark, sf_dir):
    return layout.reading_order(S.blocks(spark, sf_dir)).select("result_id", "page_id", "block_key", F.col("place").cast("int").alias("place"))


@query("block_boxes", f"with {BLOCKS} select block_key, list_min([p[1] for p in polygon]) as x0, list_min([p[2] for p in polygon]) as y0, list_max([p[1] for p in polygon]) as x1, list_max([p[2] for p in polygon]) as y1 from blocks")
def block_boxes(spark, sf_dir):
    return S.blocks(spark, sf_dir).select("block_key", *layout.box())


@query("common_elements", f"with {BOXED}, e as (select *, max(y1) over p as height, block_id = min(block_id) over p or block_id = max(block_id) over p as edge from boxed window p as (partition by result_id, page_id)), t as (select result_id, block_key, page_id, y0, height, trim(regexp_replace(lower({TEXT}), '[\\d\\s]+', ' ', 'g')) as text from e where edge and html is not null and html <> ''), n as (select *, coalesce(y0 - lag(y0) over (partition by result_id, text order by y0, block_key) <= 0.02 * height, false)::int as beside, page_id - dense_rank() over (partition by result_id, text order by page_id) as island from t where text <> ''), r as (select result_id, text, island, count(distinct page_id) as n, max(beside) as beside from n group by all), h as (select result_id, text from r join (select result_id, count(distinct page_id) as pages from blocks group by result_id) using (result_id) group by result_id, text having sum(n) >= 4 and max(beside) = 1 and (max(n) >= 3 or sum(n) >= 0.2 * max(pages))) select n.result_id, block_key from n join h on h.result_id = n.result_id and h.text = n.text")
def common_elements(spark, sf_dir):
    return layout.common_elements(S.blocks(spark, sf_dir))


@query("image_furniture", f"with {BOXED}, p as (select result_id, block_key, page_id, x0 / height as x, y0 / height as y from (select *, max(y1) over (partition by result_id, page_id) as height from boxed) where block_type = 'Picture' and (y1 <= 0.15::double * height or y0 >= 0.85::double * height)) select a.result_id, a.block_key, count(distinct b.page_id) as pages from p a join p b on a.result_id = b.result_id and abs(a.x - b.x) <= 0.015::double and abs(a.y - b.y) <= 0.015::double group by a.result_id, a.block_key having count(distinct b.page_id) >= 3")
def image_furniture(spark, sf_dir):
    return layout.image_furniture(S.blocks(spark, sf_dir))


@query("captions", f"with {BLOCKS}, n as (select *, lag(block_type) over w as bt, lag(block_key) over w as bk, lead(block_type) over w as nt, lead(block_key) over w as ak from blocks window w as (partition by result_id, page_id order by block_id)) select result_id, block_key as caption_key, case when bt in ('Picture', 'Table', 'Figure') then bk else ak end as target_key from n where block_type = 'Caption' and (bt in ('Picture', 'Table', 'Figure') or nt in ('Picture', 'Table', 'Figure'))")
def captions(spark, sf_dir):
    return layout.captions(S.blocks(spark, sf_dir))


@query("list_groups", f"with {BLOCKS}, i as (select *, block_type = 'ListItem' as is_item from blocks where block_type not in ('ListGroup', 'PageHeader', 'PageFooter')), r as (select *, row_number() over w - sum(is_item::int) over w as run from i window w as (partition by result_id order by page_id, block_id)) select result_id, arg_min(block_key, page_id * 100000 + block_id) as first_block, count(*) as items from r where is_item group by result_id, run")
def list_groups(spark, sf_dir):
    return layout.list_groups(S.blocks(spark, sf_dir))


@query("sections", f"with {BLOCKS}, s as (select result_id, section_hierarchy[list_max(map_keys(section_hierarchy))] as section_id, html from blocks where cardinality(section_hierarchy) > 0) select result_id, section_id, count(*) as blocks, sum(coalesce(length(html), 0))::bigint as chars from s group by result_id, section_id")
def sections(spark, sf_dir):
    return layout.sections(S.blocks(spark, sf_dir))


@query("contents", f"with {BLOCKS} select result_id, block_key, page_id, block_id, case when regexp_extract(html, '^<h([1-6])', 1) <> '' then regexp_extract(html, '^<h([1-6])', 1)::int end as level, {TEXT} as title from blocks where block_type = 'SectionHeader' and html is not null")
def contents(spark, sf_dir):
    return layout.contents(S.blocks(spark, sf_dir))


@query("joined_paragraphs", f"with {BLOCKS}, f as (select result_id, block_key, page_id, block_id, {TEXT} as text from blocks where block_type in ('Text', 'TextInlineMath') and html is not null and html <> ''), n as (select *, lead(block_key) over w as next_key, lead(page_id) over w as next_page, lead(text) over w as next_text from f where text <> '' window w as (partition by result_id order by page_id, block_id)) select result_id, block_key, next_key from n where next_page = page_id + 1 and (regexp_matches(text, '\\p{{L}}-$') or not regexp_matches(text, '[.!?:;…][\"''»”)]*$')) and regexp_matches(next_text, '^\\p{{Ll}}')")
def joined_paragraphs(spark, sf_dir):
    return layout.joined_paragraphs(S.blocks(spark, sf_dir))


@query("table_grids", f"with {BLOCKS} select result_id, block_key, len(regexp_extract_all(html, '<tr>'))::int as n_rows, len(regexp_extract_all(html, '<t[dh]>'))::int as n_cells from blocks where block_type = 'Table' and html is not null")
def table_grids(spark, sf_dir):
    return layout.table_grid(S.blocks(spark, sf_dir)).select("result_id", "block_key", "n_rows", "n_cells")


@query("merged_tables", f"with {BLOCKS}, g as (select result_id, block_key, page_id, block_id, len(regexp_extract_all(html, '<t[dh]>')) / greatest(len(regexp_extract_all(html, '<tr>')), 1) as columns, regexp_extract(html, '(?s)<tr>(.*?)</tr>', 1) as first_row from blocks where block_type = 'Table' and html is not null), n as (select *, lead(block_key) over w as next_key, lead(page_id) over w as next_page, lead(columns) over w as next_columns, lead(first_row) over w as next_first from g window w as (partition by result_id order by page_id, block_id)), c as (select *, list_filter([trim(regexp_replace(x, '<[^>]*>', '', 'g')) for x in regexp_extract_all(next_first, '(?s)<t[dh]>(.*?)</t[dh]>', 1)], lambda y: y <> '') as cells from n) select result_id, block_key, next_key, next_first = first_row as repeats_header from c where next_page = page_id + 1 and columns = next_columns and (next_first = first_row or (len(cells) > 0 and 2 * len(list_filter(cells, lambda y: regexp_matches(y, '^[-–+±]?\\d[\\d.,\\s]*%?$'))) >= len(cells)))")
def merged_tables(spark, sf_dir):
    return layout.merged_tables(S.blocks(spark, sf_dir))


@query("quote_levels", f"with {BOXED}, p as (select *, min(x0) over w as lft, max(x1) over w as rgt from boxed where block_type = 'Text' window w as (partition by result_id, page_id)), l as (select *, floor((x0 - lft) / greatest(rgt - lft, 1.0) / 0.02::double + 1e-9)::int as level from p) select result_id, block_key, level from l where level >= 1 and x1 <= rgt - 0.02::double * (rgt - lft)")
def quote_levels(spark, sf_dir):
    return layout.quote_levels(S.blocks(spark, sf_dir))


@query("list_levels", f"with {BOXED} select result_id, block_key, dense_rank() over (partition by result_id, page_id order by floor(x0 / 5.0))::int as level from boxed where block_type = 'ListItem' and x0 is not null")
def list_levels(spark, sf_dir):
    return layout.list_levels(S.blocks(spark, sf_dir))


@query("footnotes", f"with {BLOCKS}, t as (select result_id, block_key, {TEXT} as text from blocks where block_type = 'Footnote' and html is not null) select result_id, block_key, nullif(regexp_extract(text, '^(\\d{{1,3}}|[*†‡]+)[.)]?\\s+\\S', 1), '') as mark, trim(regexp_replace(text, '^(\\d{{1,3}}|[*†‡]+)[.)]?\\s+', '')) as text from t")
def footnotes(spark, sf_dir):
    return layout.footnotes(S.blocks(spark, sf_dir))


@query("numbered_margins")
def numbered_margins(spark, sf_dir):
    return layout.numbered_margins(S.blocks(spark, sf_dir))


@query("heading_heights")
def heading_heights(spark, sf_dir):
    return layout.heading_heights(S.blocks(spark, sf_dir))


@query("plain_block_texts", f"with {BLOCKS} select block_key, sha256(regexp_replace(regexp_replace(regexp_replace(replace(replace(replace(replace(replace(replace(replace({TEXT}, 'ﬀ', 'ff'), 'ﬃ', 'ffi'), 'ﬄ', 'ffl'), 'ﬁ', 'fi'), 'ﬂ', 'fl'), 'ﬅ', 'st'), 'ﬆ', 'st'), '\\r\\n?', chr(10), 'g'), '[\\t\\x{{00A0}}\\x{{2000}}-\\x{{200A}}\\x{{202F}}\\x{{205F}}\\x{{3000}}]', ' ', 'g'), '[\\x00-\\x08\\x0B\\x0C\\x0E-\\x1F\\x7F-\\x{{9F}}]', '', 'g')) as digest from blocks where html is not null")
def plain_block_texts(spark, sf_dir):
    """A digest of each block's text with plain characters, so texts that are equal but for them meet."""
    return S.blocks(spark, sf_dir).where("html is not null").select("block_key", F.sha2(K.plain_characters(layout.visible_text(F.col("html"))), 256).alias("digest"))


MARKDOWN_SQL = f"""with {BLOCKS}, flow as (select *, regexp_extract(html, '^<h([1-6])', 1) as level, {TEXT} as text,
  [('| ' || array_to_string([{TEXT.replace('html', 'c')} for c in regexp_extract_all(r, '(?s)<t[dh]>(.*?)</t[dh]>', 1)], ' | ') || ' |') for r in regexp_extract_all(html, '(?s)<tr>(.*?)</tr>', 1)] as rows
  from blocks where html is not null and html <> '' and block_type not in ('PageHeader', 'PageFooter', 'ListGroup')),
md as (select result_id, page_id, block_id, case block_type when 'SectionHeader' then repeat('#', case when level <> '' then level::int else 1 end) || ' ' || text when 'ListItem' then '- ' || text
  when 'Code' then '```' || chr(10) || text || chr(10) || '```' when 'Equation' then '$$ ' || text || ' $$'
  when 'Table' then case when len(rows) > 0 then rows[1] || chr(10) || regexp_replace(regexp_replace(rows[1], '[^|]+', ' --- ', 'g'), '^ --- ', '') || case when len(rows) > 1 then chr(10) || array_to_string(rows[2:], chr(10)) else '' end else text end else text end as md from flow)
select result_id, string_agg(md, chr(10) || chr(10) order by page_id, block_id, md) as body from md where md <> '' group by result_id"""


@query("blocks_to_markdown", MARKDOWN_SQL)
def blocks_to_markdown(spark, sf_dir):
    return layout.to_markdown(S.blocks(spark, sf_dir))


EDIT_SQL = r"""with e as (select *, regexp_extract_all(old_text, '\d+') as od, regexp_extract_all(new_text, '\d+') as nd from edit_replies)
select reply_id, case when new_text is null or old_text is null then 'no text' when old_text = new_text then 'no change' when od <> nd then 'digits changed'
 when regexp_extract_all(old_text, '!\[[^\]]*\]\(([^)]*)\)', 1) <> regexp_extract_all(new_text, '!\[[^\]]*\]\(([^)]*)\)', 1) then 'image changed'
 when regexp_extract(old_text, '^(#{1,6} |)', 1) <> regexp_extract(new_text, '^(#{1,6} |)', 1) then 'heading mark changed'
 when length(old_text) - length(replace(old_text, '|', '')) <> length(new_text) - length(replace(new_text, '|', '')) then 'row shape changed'
 when (length(old_text) - length(replace(old_text, '$', ''))) % 2 <> (length(new_text) - length(replace(new_text, '$', ''))) % 2 then 'formula signs changed'
 when contains(new_text, '\n') and not contains(old_text, '\n') then 'literal escape'
 when regexp_matches(new_text, '^\s*[{\[]"') then 'reply syntax'
 when regexp_matches(old_text, '\p{L}-$') and not regexp_matches(new_text, '-$') then 'line break hyphen lost' end as reason from e"""


@query("edit_reasons", EDIT_SQL)
def edit_reasons(spark, sf_dir):
    return S.table(spark, sf_dir, "edit_replies").select("reply_id", edits.reason().alias("reason"))


@query("placed_edits", f"with {LINES}, h as (select e.reply_id, l.line_no, e.line - 1 as spot from edit_replies e join lines l on l.result_id = e.result_id and abs(l.line_no - (e.line - 1)) <= 40 where e.old_text <> '' and contains(l.line, e.old_text)), b as (select reply_id, count(*) as n, max((line_no = spot)::int) as exact, min(line_no) as one, min(spot) as spot from h group by reply_id) select reply_id, (case when exact = 1 then spot else one end)::int as line_no from b where exact = 1 or n = 1")
def placed_edits(spark, sf_dir):
    return edits.placed(S.table(spark, sf_dir, "edit_replies"), L.explode_lines(S.bodies(spark, sf_dir)))


@query("findings")
def all_findings(spark, sf_dir):
    return findings.findings(S.bodies(spark, sf_dir))


def edit_lists(spark, sf_dir):
    """Bodies after the edits of the replies, and the outcome of every edit."""
    return inspection.edited(S.bodies(spark, sf_dir), S.table(spark, sf_dir, "edit_replies").dropDuplicates(["reply_id"]))


@query("repair_zones")
def repair_zones(spark, sf_dir):
    return post.body_zones(S.bodies(spark, sf_dir))


@query("edited_bodies")
def edited_bodies(spark, sf_dir):
    return edit_lists(spark, sf_dir)[0]


@query("edit_outcomes")
def edit_outcomes(spark, sf_dir):
    return edit_lists(spark, sf_dir)[1]


@query("line_addresses", f"with {LINES}, p as (select *, coalesce(page, 0) as page0 from lines), n as (select *, row_number() over (partition by result_id, page0 order by line_no) as k from p) select result_id, line_no::int as line_no, page0 || '.' || k || ': ' || line as address from n")
def line_addresses(spark, sf_dir):
    return inspection.numbered(S.bodies(spark, sf_dir))


@query("page_tokens", f"with {LINES} select result_id, coalesce(page, 0) as page, ceil(sum(length(line) + 1) / 3)::bigint as tokens from lines group by result_id, coalesce(page, 0)")
def page_tokens(spark, sf_dir):
    return edits.page_tokens(zoned(spark, sf_dir))


@query("page_chunks", f"with {LINES}, p as (select result_id, coalesce(page, 0) as page, ceil(sum(length(line) + 1) / 3)::bigint as tokens from lines group by result_id, coalesce(page, 0)), o as materialized (select *, row_number() over (partition by result_id order by page) as k from p), c(result_id, page, k, chunk, have, n) as (select result_id, page, k, 0, tokens, 1 from o where k = 1 union all select o.result_id, o.page, o.k, case when have + tokens <= 2000 and n < 8 then chunk else chunk + 1 end, case when have + tokens <= 2000 and n < 8 then have + tokens else tokens end, case when have + tokens <= 2000 and n < 8 then n + 1 else 1 end from c join o on o.result_id = c.result_id and o.k = c.k + 1) select result_id, page::int as page, chunk::int as chunk from c")
def page_chunks(spark, sf_dir):
    return edits.chunks(edits.page_tokens(zoned(spark, sf_dir)))




@query("latest_headers", f"with {LAST} select result_id, archive_id, source, status, score from last")
def latest_headers(spark, sf_dir):
    return S.headers(spark, sf_dir).select("result_id", "archive_id", "source", "status", "score")


@query("unfinished", f"with {LAST}, done as (select distinct source, source_hash from last where status in ('ok', 'bad')) select result_id, source from last l where not exists (select 1 from done d where d.source = l.source and d.source_hash = l.source_hash)")
def unfinished(spark, sf_dir):
    h = S.headers(spark, sf_dir)
    return S.unfinished(h.select("result_id", "source", "source_hash"), h).select("result_id", "source")


@query("issue_rollup", f"with {LAST} select a.lang, l.status, count(*) as files, count(l.score) as scored, sum(len(l.issues))::bigint as issues from last l join archives a using (archive_id) group by rollup (a.lang, l.status)")
def issue_rollup(spark, sf_dir):
    h = S.headers(spark, sf_dir).join(S.table(spark, sf_dir, "archives").select("archive_id", "lang"), "archive_id")
    return h.rollup("lang", "status").agg(F.count("*").alias("files"), F.count("score").alias("scored"), F.sum(F.when(F.col("issues").isNotNull(), F.size("issues"))).alias("issues"))


@query("run_summary", f"with {LAST} select engine, count(*) as files, count(*) filter (where status = 'bad') as bad, count(*) filter (where status = 'in_progress') as open, max(case when status = 'in_progress' then 1 when status = 'bad' then 4 else 0 end)::int as exit_code from last group by engine")
def run_summary(spark, sf_dir):
    code = F.max(F.when(F.col("status") == "in_progress", 1).when(F.col("status") == "bad", 4).otherwise(0)).alias("exit_code")
    return S.headers(spark, sf_dir).groupBy("engine").agg(F.count("*").alias("files"), F.count(F.when(F.col("status") == "bad", 1)).alias("bad"), F.count(F.when(F.col("status") == "in_progress", 1)).alias("open"), code)


@query("name_collisions", f"with {LAST} select result_id, source, count(*) over (partition by archive_id, lower(regexp_replace(source, '\\.[A-Za-z0-9]{{1,5}}$', ''))) as same_name from last where source is not null")
def name_collisions(spark, sf_dir):
    stem = F.lower(F.regexp_replace("source", r"\.[A-Za-z0-9]{1,5}$", ""))
    return S.headers(spark, sf_dir).where("source is not null").select("result_id", "source", F.count("*").over(Window.partitionBy("archive_id", stem)).alias("same_name"))


@query("result_names", f"with {LAST} select result_id, regexp_replace(regexp_replace(regexp_replace(source, '\\.[A-Za-z0-9]{{1,5}}$', ''), '[<>:\"/\\\\|?*]', '_', 'g'), '[. ]+$', '') || case when ends_with(lower(source), '.md') then '_cleaned.md' else '.md' end as target from last where source is not null")
def result_names(spark, sf_dir):
    return S.headers(spark, sf_dir).where("source is not null").select("result_id", S.target_name(F.col("source")).alias("target"))


@query("source_hashes", f"with {DOCS} select result_id, rtrim(replace(replace(base64(unhex(sha256(body))), '+', '-'), '/', '_'), '=') as source_hash from docs where body is not null")
def source_hashes(spark, sf_dir):
    return S.bodies(spark, sf_dir).where("body is not null").select("result_id", K.url_hash(F.encode("body", "UTF-8")).alias("source_hash"))


@query("census", f"with {LAST}, d as (select distinct result_id, body from ocr_results) select count(*) as annotated, count(*) filter (where d.result_id is null) as missing, count(*) filter (where d.result_id is not null and coalesce(body, '') = '') as failed, count(*) filter (where coalesce(body, '') <> '') as scored from (select distinct result_id from structure_counts) s left join d using (result_id)")
def census(spark, sf_dir):
    d = S.bodies(spark, sf_dir).select("result_id", F.lit(1).alias("there"), F.coalesce("body", F.lit("")).alias("body"))
    s = S.table(spark, sf_dir, "structure_counts").select("result_id").distinct().join(d, "result_id", "left")
    n = lambda c: F.count(F.when(c, 1))
    return s.agg(F.count("*").alias("annotated"), n(F.col("there").isNull()).alias("missing"), n(F.col("there").isNotNull() & (F.col("body") == "")).alias("failed"), n(F.col("body") != "").alias("scored"))


@query("score_pivot", f"with {LAST}, p as (select a.lang, l.status from last l join archives a using (archive_id)) select lang, count(*) filter (where status = 'ok') as ok, count(*) filter (where status = 'bad') as bad, count(*) filter (where status = 'in_progress') as in_progress from p group by lang")
def score_pivot(spark, sf_dir):
    h = S.headers(spark, sf_dir).join(S.table(spark, sf_dir, "archives").select("archive_id", "lang"), "archive_id")
    return h.groupBy("lang").pivot("status", ["ok", "bad", "in_progress"]).count().na.fill(0, ["ok", "bad", "in_progress"])


@query("score_table", f"with {LAST}, p as (select a.lang, l.engine, l.score from last l join archives a using (archive_id)) select lang, engine, count(*) as files, count(score) as scored, round(avg(score), 4) as mean_score, min(score) as least, max(score) as most, quantile_cont(score, 0.5) as middle from p group by lang, engine")
def score_table(spark, sf_dir):
    """Scores of each language and engine: mean, extremes and median."""
    h = S.headers(spark, sf_dir).join(S.table(spark, sf_dir, "archives").select("archive_id", "lang"), "archive_id")
    return h.groupBy("lang", "engine").agg(F.count("*").alias("files"), F.count("score").alias("scored"), F.round(F.avg("score"), 4).alias("mean_score"), F.min("score").alias("least"), F.max("score").alias("most"), F.percentile("score", F.lit(0.5)).alias("middle"))


@query("source_recall", f"with {PROSE}, t as (select result_id, unnest(texts) as t from (select check_id, any_value(result_id) as result_id, any_value(texts) as texts from ocr_error_checks where texts is not null group by check_id)), there as (select result_id, word, count(*) as n from (select result_id, unnest(regexp_extract_all(lower(t), '\\p{{L}}+')) as word from t where t is not null) group by all) select h.result_id, round(sum(case when w.word is not null then h.n else 0 end) / sum(h.n), 6)::double as share from there h left join words w on h.result_id = w.result_id and h.word = w.word group by h.result_id")
def source_recall(spark, sf_dir):
    """Share of the words of a result's check texts that its body has: the other way of source_coverage."""
    checks = S.table(spark, sf_dir, "ocr_error_checks").where("texts is not null").dropDuplicates(["check_id"])
    there = checks.select("result_id", F.explode("texts").alias("t")).where("t is not null").select("result_id", F.explode(F.regexp_extract_all(F.lower("t"), F.lit(r"(\p{L}+)"), 1)).alias("word")).groupBy("result_id", "word").agg(F.count("*").alias("n"))
    return words.coverage(there, words.word_counts(zoned(spark, sf_dir))).select("result_id", F.round("share", 6).alias("share"))


@query("events_tumbling", "select date_trunc('hour', ts) as start_ts, event_type, count(*) as n, round(sum(value), 4) as total from events group by all")
def events_tumbling(spark, sf_dir):
    return E.tumbling(S.table(spark, sf_dir, "events"))


@query("events_sliding", "select s as start_ts, count(*) as n from (select unnest([date_trunc('hour', ts), date_trunc('hour', ts) - interval 1 hour]) as s from events) group by s")
def events_sliding(spark, sf_dir):
    return E.sliding(S.table(spark, sf_dir, "events"))


@query("events_sessions", "with g as (select user_id, ts, case when ts - lag(ts) over w < interval 30 minute then 0 else 1 end as fresh from events where user_id is not null window w as (partition by user_id order by ts)), s as (select *, sum(fresh) over (partition by user_id order by ts rows unbounded preceding) as k from g) select user_id, min(ts) as start_ts, count(*) as n from s group by user_id, k")
def events_sessions(spark, sf_dir):
    return E.sessions(S.table(spark, sf_dir, "events").where("user_id is not null"))


@query("streamed_lines", f"with {RAW} select result_id, count(*) as lines from raw group by result_id")
def streamed_lines(spark, sf_dir):
    """Bodies read as a stream of files, one batch after the other, then the batches together."""
    base = shared.fresh(spark, "stream")
    E.drain(E.read_stream(spark, sf_dir, "ocr_results"), f"{base}/out", f"{base}/state", lambda df: L.explode_lines(df.where("result_id is not null and body is not null").dropDuplicates(["result_id"])).groupBy("result_id").agg(F.count("*").alias("lines")))
    return spark.read.parquet(f"{base}/out").groupBy("result_id").agg(F.max("lines").alias("lines"))
