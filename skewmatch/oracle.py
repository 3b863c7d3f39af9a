"""DuckDB SQL for every registered query, written independently of the
Spark code: plain joins, window functions and recursive CTEs over the driver
tables. Used as the correctness oracle.
"""

from __future__ import annotations

PARTS = 4
REDUCERS = 4


LINE_BITS = 2 ** 32  # an array has fewer lines; ids are HUGEINT here only


def _lines(table: str, rid: str, text: str) -> str:
    return f"""select {rid}::HUGEINT * {LINE_BITS} + i as id, {rid}, i::BIGINT as line_no, t[i + 1] as text
  from (select {rid}, case when regexp_full_match({text}, '\\n+') then []::VARCHAR[]
               else string_split(regexp_replace({text}, '\\n+$', ''), chr(10)) end as t
        from {table}) s, unnest(range(len(t))) as u(i)"""


ID_AB = ", ".join(f"(id_{x} // {LINE_BITS})::BIGINT as doc_id_{x}, (id_{x} % {LINE_BITS})::BIGINT as line_no_{x}" for x in "ab")

# The edit distance here counts bytes. To count characters, every non-ASCII letter of the lower-cased
# texts of a table is mapped to a control character of its own; too many letters, or a text that
# holds such a control character itself, is an error.
CODES = [*range(1, 9), 11, 12, *range(14, 32), 127]


def _letters(table: str, text: str) -> str:
    codes = " || ".join(f"chr({c})" for c in CODES)
    return f"""letters as (
  select case when count(*) > {len(CODES)} then error('more letters than codes') else coalesce(string_agg(c, ''), '') end as chars,
         {codes} as codes
  from (select distinct unnest(regexp_extract_all(lower({text}), '[^\\x00-\\x7F]')) as c from {table}) x),
clash as (select case when count(*) > 0 then error('a text holds a code') end as none
  from {table} where regexp_matches({text}, '[\\x01-\\x08\\x0B\\x0C\\x0E-\\x1F\\x7F]'))"""


def _low(text: str) -> str:
    return (f"translate(lower({text}), (select chars from letters), "
            f"(select left(codes, length(chars)) || coalesce((select none::VARCHAR from clash), '') from letters))")


# upper('ß') is 'SS' (full case mapping)
KEY4 = ("case when length(text) < 3 then '>>>' "
        "else upper(replace(replace(substring(text, 1, 3), '.', ','), 'ß', 'ss')) end")
KEY5 = "case when length(text) < 3 then '>>>' else substring(lower(text), 1, 3) end"


def _sim(a: str, b: str, low_a: str = "", low_b: str = "") -> str:
    longer = f"greatest(length({a}), length({b}))"
    return (f"case when {longer} = 0 then 1.0 else "
            f"({longer} - levenshtein({low_a or f'lower({a})'}, {low_b or f'lower({b})'}))::DOUBLE / {longer} end")


def _usize(rem: str, t: str) -> str:
    b = f"(2 * {rem} - 1)::DOUBLE"
    disc = f"({b} * {b} - 8.0 * {t})"
    return f"(case when {disc} < 0 then 0 else floor(({b} - sqrt({disc})) / 2) end)::BIGINT"


DOCS = f"docs as ({_lines('documents', 'doc_id', 'text')})"
LOW = _letters("documents", "text")
KEYED = f"keyed as (select id, doc_id, line_no, text, {KEY4} as block, ((doc_id + line_no) % {PARTS})::BIGINT as part from docs)"
STATS = f"""counts as (select block, part, count(*)::BIGINT as size from keyed group by block, part),
bsz as (select block, sum(size)::BIGINT as n, (sum(size) * (sum(size) - 1) // 2)::BIGINT as comps
        from counts group by block),
tot as (select count(*)::BIGINT as n_blocks, sum(n)::BIGINT as n_entities, sum(comps)::BIGINT as total_comps,
               {REDUCERS}::BIGINT as reducers, ((sum(comps) + {REDUCERS - 1}) // {REDUCERS})::BIGINT as target
        from bsz),
stats as (select bsz.*, tot.target, bsz.comps > tot.target as oversized from bsz cross join tot)"""
SPLIT_PLAN = """split_plan as (
  select block, 0::BIGINT as i, 0::BIGINT as j, comps from stats where not oversized and comps > 0
  union all
  select a.block, a.part, b.part,
         (case when a.part = b.part then a.size * (a.size - 1) // 2 else a.size * b.size end)::BIGINT
  from counts a join counts b on a.block = b.block and b.part <= a.part
  where a.block in (select block from stats where oversized))"""


def _greedy(plan: str, order: str, name: str) -> str:
    return f"""{name}_ranked as (
  select *, (row_number() over (order by comps desc, {order}) - 1)::BIGINT as rank from {plan}),
{name}_greedy(step, loads, pick) as (
  select -1::BIGINT, list_transform(range({REDUCERS}), lambda x: 0::BIGINT), NULL::BIGINT
  union all
  select g.step + 1,
         list_transform(g.loads, lambda x, k: case when k = list_position(g.loads, list_min(g.loads))
                                                   then x + r.comps else x end),
         (list_position(g.loads, list_min(g.loads)) - 1)::BIGINT
  from {name}_greedy g join {name}_ranked r on r.rank = g.step + 1),
{name} as (select r.*, g.pick as reducer from {name}_ranked r join {name}_greedy g on g.step = r.rank)"""


SLICE_PLAN = f"""sl(block, target, s, start, rem, done) as (
  select block, target, 1, 0::BIGINT, n, false from stats where oversized
  union all
  select block, target, s + 1, start + u, rem - u, u = 0
  from (select *, {_usize('rem', 'target')} as u from sl where not done) x),
slice_plan as (
  select block, 0::BIGINT as slice, 0::BIGINT as start, n as rem, n as u, comps
  from stats where not oversized and comps > 0
  union all
  select block, (case when u = 0 then 0 else s end)::BIGINT, start, rem,
         case when u = 0 then rem else u end,
         (case when u = 0 then rem * (rem - 1) // 2 else u * (u - 1) // 2 + (rem - u) * u end)::BIGINT
  from (select *, {_usize('rem', 'target')} as u from sl where not done) y)"""

POSITIONS = """posd as (select k.*, (row_number() over (partition by block order by id) - 1)::BIGINT as pos from keyed k)"""


def _with(*ctes: str, recursive: bool = False) -> str:
    return ("with recursive " if recursive else "with ") + ",\n".join(ctes) + "\n"


def _pairs_by_block(keyed: str, low: str = "lower(text)") -> str:
    return f"""select a.id as id_a, b.id as id_b, a.text as text_a, b.text as text_b,
       {_sim('a.text', 'b.text', 'a.low', 'b.low')} as similarity
from (select *, {low} as low from {keyed}) a join (select *, {low} as low from {keyed}) b on a.block = b.block and a.id < b.id"""


def _doc_matches(key: str) -> str:
    return (_with(DOCS, LOW, f"keyed as (select id, text, {key} as block from docs)")
            + f"select {ID_AB}, text_a, text_b, similarity from (" + _pairs_by_block("keyed", _low("text"))
            + ") p where similarity >= 0.7")


DOC_MATCHES = _doc_matches(KEY4)
DOC_MATCHES_BASIC = _doc_matches(KEY5)

PAGES = "pages_e as (select id, text, " + KEY4 + " as block from (select page_id as id, url as text from pages) p)"
PAGE_MATCHES = (_with(PAGES) + "select * from (" + _pairs_by_block("pages_e") + ") p where similarity >= 0.7")

BENCH = f"""bl as (select item_id, l as line from benchmark,
   unnest(case when regexp_full_match(text, '\\n+') then []::VARCHAR[]
               else string_split(regexp_replace(text, '\\n+$', ''), chr(10)) end) as u(l)),
src1 as (select distinct line from bl where item_id % 2 = 0),
src2 as (select distinct line from bl where item_id % 2 = 1),
w1 as (select w as word from src1, unnest(string_split(line, ' ')) as u(w) where w <> ''),
w2 as (select w as word from src2, unnest(string_split(line, ' ')) as u(w) where w <> '')"""


def _next_pairs(table: str, id_col: str, text_col: str, where: str = "") -> str:
    return f"""select * from (select a.{id_col} as id_a, b.{id_col} as id_b, a.{text_col} as text_a,
       b.{text_col} as text_b, {_sim(f'a.{text_col}', f'b.{text_col}')} as similarity
from {table} a join {table} b on b.{id_col} = a.{id_col} + 1) p {where}"""


PARTS_E = ("parts_e as (select id, text, " + KEY4 + " as block from (select p_partkey as id, p_name as text from part) p)")
PARTS_E5 = ("parts_e as (select id, text, " + KEY5 + " as block from (select p_partkey as id, p_name as text from part) p)")
PART_MATCHES = (_with(PARTS_E) + "select * from (" + _pairs_by_block("parts_e") + ") p where similarity >= 0.7")
PART_MATCHES_BASIC = (_with(PARTS_E5) + "select * from (" + _pairs_by_block("parts_e") + ") p where similarity >= 0.7")

PAGE_LINES = "pl as (" + _lines("(select page_id, regexp_replace(html, '<[^>]*>', chr(10), 'g') as text from pages)", "page_id", "text") + ")"

SPLIT_ASSIGNED = _greedy("split_plan", "block, i, j", "split_assigned")
SLICE_ASSIGNED = _greedy("slice_plan", "block, slice", "slice_assigned")

SPLIT_ROUTE = """split_route as (
  select a.reducer, k.block, a.i, a.j, k.part, k.doc_id, k.line_no, s.oversized
  from keyed k join stats s on s.block = k.block join split_assigned a on a.block = k.block
  where (not s.oversized) or k.part = a.i or k.part = a.j)"""

ORACLE = {
    "entity_lines": _with(DOCS) + "select doc_id, line_no, text from docs",
    "drop_empty_lines": _with(PAGE_LINES) + "select page_id, line_no, text from pl where text <> ''",
    "file_lines": """select (row_number() over (order by doc_id, i) - 1)::BIGINT as id, t[i] as text from
        (select doc_id, string_split(regexp_replace(text, '\r\n?', chr(10), 'g'), chr(10)) as t from documents where text is not null) s,
        unnest(range(1, len(t) + 1)) as u(i)""",
    "write_matches": PAGE_MATCHES,
    "block_key_prefix": _with(DOCS) + f"select doc_id, line_no, text, {KEY4} as block from docs",
    "block_key_prefix_lower": _with(DOCS) + f"select doc_id, line_no, text, {KEY5} as block from docs",
    "block_key_first_char": _with(BENCH) + """select word, substring(lower(word), 1, 1) as block
        from (select word from w1 union all select word from w2) w""",
    "tokenize_words": _with(BENCH.split(",\nsrc1")[0]) + """select w as word, (case when item_id % 2 = 0 then 1 else 2 end) as source
        from bl, unnest(string_split(line, ' ')) as u(w) where w <> ''""",
    "distinct_lines": _with(DOCS) + "select distinct text from docs",
    "source_partition": _with(DOCS) + f"select doc_id, line_no, ((doc_id + line_no) % {PARTS})::BIGINT as part from docs",
    "mark_empty_entities": _with(PAGE_LINES) + f"""select page_id, line_no, {KEY4} as block,
        case when text = '' then '<><><>' else text end as text from pl""",
    "string_similarity": _next_pairs("part", "p_partkey", "p_name"),
    "score_pairs": _next_pairs("pages", "page_id", "url"),
    "filter_similar": _next_pairs("pages", "page_id", "url", "where similarity >= 0.7"),
    "block_partition_counts": _with(DOCS, KEYED) + "select block, part, count(*)::BIGINT as size from keyed group by all",
    "block_distribution_matrix": _with(DOCS, KEYED, STATS) + """select block, n, comps,
        (select string_agg(c.part || ':' || c.size, ',' order by c.part) from counts c where c.block = s.block) as sizes
        from stats s""",
    "block_partition_size": _with(DOCS, KEYED, STATS) + f"""select s.block, p.part, coalesce(c.size, 0)::BIGINT as size
        from stats s cross join (select range::BIGINT as part from range({PARTS})) p
        left join counts c on c.block = s.block and c.part = p.part""",
    "block_index": _with(DOCS, KEYED, STATS) + "select block, (row_number() over (order by block) - 1)::BIGINT as block_index from stats",
    "block_sizes": _with(DOCS, KEYED, STATS) + "select block, n, comps from bsz",
    "block_totals": _with(DOCS, KEYED, STATS) + "select * from tot",
    "oversized_blocks": _with(DOCS, KEYED, STATS) + "select block, n, comps, target from stats where oversized",
    "block_members": _with(DOCS, KEYED, POSITIONS) + """select block, chunk, string_agg(doc_id || ':' || line_no, ',' order by id) as ids,
        count(*)::BIGINT as n from (select block, id, doc_id, line_no, pos // 256 as chunk from posd) x group by block, chunk""",
    "block_cogroup": _with(BENCH) + """select block, chunk,
        coalesce(string_agg(word, ' ' order by word) filter (where side = 0), '') as left,
        coalesce(string_agg(word, ' ' order by word) filter (where side = 1), '') as right,
        count(*) filter (where side = 0) as n_left, count(*) filter (where side = 1) as n_right
        from (select *, ((row_number() over (partition by block, side order by word) - 1) // 256)::BIGINT as chunk
              from (select word, 0 as side, substring(lower(word), 1, 1) as block from w1
                    union all select word, 1, substring(lower(word), 1, 1) from w2) w) x
        group by block, chunk""",
    "split_plan": _with(DOCS, KEYED, STATS, SPLIT_PLAN) + "select * from split_plan",
    "slice_size": _with(DOCS, KEYED, STATS) + f"select block, n, target, {_usize('n', 'target')} as u from stats",
    "slice_cost": _with(DOCS, KEYED, STATS) + f"""select block, n, u,
        (case when u = 0 then n * (n - 1) // 2 else u * (u - 1) // 2 + (n - u) * u end)::BIGINT as comps
        from (select *, {_usize('n', 'target')} as u from stats) x""",
    "slice_plan": _with(DOCS, KEYED, STATS, SLICE_PLAN, recursive=True) + "select * from slice_plan",
    "tasks_by_cost": _with(DOCS, KEYED, STATS, SPLIT_PLAN) + """select *,
        (row_number() over (order by comps desc, block, i, j) - 1)::BIGINT as rank from split_plan""",
    "assign_reducers": _with(DOCS, KEYED, STATS, SPLIT_PLAN, SPLIT_ASSIGNED, recursive=True)
        + "select * from split_assigned",
    "reducer_load": _with(DOCS, KEYED, STATS, SPLIT_PLAN, SPLIT_ASSIGNED, recursive=True)
        + "select reducer, sum(comps)::BIGINT as comps, count(*)::BIGINT as tasks from split_assigned group by reducer",
    "split_route": _with(DOCS, KEYED, STATS, SPLIT_PLAN, SPLIT_ASSIGNED, SPLIT_ROUTE, recursive=True)
        + "select reducer, block, i, j, part, doc_id, line_no from split_route",
    "slice_route": _with(DOCS, KEYED, STATS, SLICE_PLAN, SLICE_ASSIGNED, POSITIONS, recursive=True)
        + f"""select a.reducer, k.block, a.slice, k.pos, k.pos >= a.start + a.u as replicated, k.doc_id, k.line_no
        from posd k join slice_assigned a on a.block = k.block and k.pos >= a.start""",
    "place_by_reducer": _with(DOCS, KEYED, STATS, SPLIT_PLAN, SPLIT_ASSIGNED, SPLIT_ROUTE, recursive=True)
        + f"select reducer % {REDUCERS} as partition, reducer, count(*)::BIGINT as rows from split_route group by reducer",
    "basic_match": DOC_MATCHES_BASIC,
    "split_match": DOC_MATCHES,
    "split_match_tagged": _with(DOCS, LOW, KEYED, STATS, SPLIT_PLAN, SPLIT_ASSIGNED, f"low as (select *, {_low('text')} as low from keyed)", recursive=True) + f"""
        select {ID_AB}, m.text_a, m.text_b, m.similarity, a.reducer, m.block, a.i, a.j,
               m.part_a, m.part_b
        from (select a.id as id_a, b.id as id_b, a.text as text_a, b.text as text_b,
                     {_sim('a.text', 'b.text', 'a.low', 'b.low')} as similarity, a.block, a.part as part_a, b.part as part_b
              from low a join low b on a.block = b.block and a.id < b.id) m
        join stats s on s.block = m.block
        join split_assigned a on a.block = m.block
          and a.i = case when s.oversized then greatest(m.part_a, m.part_b) else 0 end
          and a.j = case when s.oversized then least(m.part_a, m.part_b) else 0 end
        where m.similarity >= 0.7""",
    "slice_match": DOC_MATCHES,
    "two_source_match": _with(BENCH, _letters("benchmark", "text"),
                              *[f"c{n} as (select word, count(*) as n, {_low('word')} as low from w{n} group by word)" for n in (1, 2)])
        + f"""select * from (select a.word as word_a, b.word as word_b,
        {_sim('a.word', 'b.word', 'a.low', 'b.low')} as similarity, a.n * b.n as occurrences
        from c1 a join c2 b on substring(lower(a.word), 1, 1) = substring(lower(b.word), 1, 1)) p
        where similarity >= 0.7""",
    "length_distribution": _with(DOCS, KEYED) + """select block,
        (case when length(lower(text)) = 0 then -9 else floor(ln(length(lower(text))::DOUBLE) / (ln(1 / 0.7) + 1e-6)) end)::BIGINT as band,
        count(*) as n, sum(length(lower(text)) + 1)::BIGINT as chars, sum((length(lower(text)) + 1) ** 2)::BIGINT as squares
        from keyed group by all""",
    "distinct_match": _with(DOCS, LOW, KEYED, f"""reps as (select block, lower(text) as text, length(text) as len, {_low('text')} as low,
        count(*) as n from keyed group by all)""") + """select * from (select a.block, a.text as low_a, b.text as low_b,
        case when greatest(a.len, b.len) = 0 then 1.0
             else (greatest(a.len, b.len) - levenshtein(a.low, b.low))::DOUBLE / greatest(a.len, b.len) end as similarity, a.n as n_a, b.n as n_b
        from reps a join reps b on a.block = b.block and (a.text < b.text or (a.text = b.text and a.len < b.len))) p where similarity >= 0.7""",
    "plan_lookup": _with(DOCS, KEYED, STATS, SPLIT_PLAN, SPLIT_ASSIGNED, recursive=True) + """
        select k.doc_id, k.line_no, k.block, k.part, s.n, s.comps, s.oversized, coalesce(t.n_tasks, 0) as n_tasks
        from keyed k join stats s on s.block = k.block
        left join (select block, count(*)::BIGINT as n_tasks from split_assigned group by block) t on t.block = k.block""",
    "split_match_pages": PAGE_MATCHES,
    "slice_match_pages": PAGE_MATCHES,
    "basic_match_parts": PART_MATCHES_BASIC,
    "split_match_parts": PART_MATCHES,
    "slice_match_parts": PART_MATCHES,
    "assign_reducers_slices": _with(DOCS, KEYED, STATS, SLICE_PLAN, SLICE_ASSIGNED, recursive=True)
        + "select * from slice_assigned",
    "reducer_load_slices": _with(DOCS, KEYED, STATS, SLICE_PLAN, SLICE_ASSIGNED, recursive=True)
        + "select reducer, sum(comps)::BIGINT as comps, count(*)::BIGINT as tasks from slice_assigned group by reducer",
}
