"""SQL of the queries p1 to p5."""

_LEVELS = """lv as (select id, max(level) as level from (
  select id, level from revisions where type is distinct from 'NEW' union all
  select id, level from revisions_backup) where id is not null and level is not null group by id)"""

_FOREST = f"""{_LEVELS},
links as (select distinct revision_id, parent_id from diffs where revision_id is not null),
forest as (select revision_id as node, arg_min(parent_id, rn) as parent from (
  select l.revision_id, l.parent_id, row_number() over (partition by l.revision_id
    order by (l.parent_id is null), (v.level is null), v.level desc, l.parent_id) as rn
  from links l left join lv v on v.id = l.parent_id) where rn = 1 group by revision_id)"""

# A way of more steps than there are nodes is a circle; circles are found by walking from each node that reaches no root.
_WALK = f"""{_FOREST},
roots as (select node as id from forest where parent is null union
  select parent from forest where parent is not null and parent not in (select node from forest)),
tree(node, root, depth, path) as (
  select id, id, 0::bigint, [id] from roots union all
  select f.node, t.root, t.depth + 1, list_append(t.path, f.node) from forest f join tree t on f.parent = t.node)"""

_CIRCLES = """stuck as (select node, parent from forest where node not in (select node from tree)),
way(node, spot, steps) as (select node, parent, 1 from stuck union all
  select w.node, s.parent, w.steps + 1 from way w join stuck s on s.node = w.spot where w.steps <= (select count(*) from stuck) and w.spot <> w.node),
ring as (select distinct node from way where spot = node),
ringway(node, spot) as (select node, node from ring union select w.node, s.parent from ringway w join stuck s on s.node = w.spot),
low as (select node, min(spot) as circle from ringway group by node)"""

ORACLE = {
    "p1_found": f"""with recursive {_WALK}, {_CIRCLES},
off(node, spot) as (select node, node from stuck union select o.node, s.parent from off o join stuck s on s.node = o.spot)
select node as revision_id, root as root_id, depth from tree where node in (select node from forest)
union all
select o.node, min(l.circle), -1::bigint from off o join low l on l.node = o.spot group by o.node""",
    "p1_paths": f"""with recursive {_WALK},
below as (select a as node, count(*) - 0 as n from (select node, unnest(path[1:len(path) - 1]) as a from tree) group by a)
select t.node as revision_id, t.path, coalesce(b.n, 0)::bigint as descendants from tree t left join below b on b.node = t.node
where t.node in (select node from forest)
union all
select node, null, null from forest where node not in (select node from tree)""",
    "p1_descendants": f"""with recursive {_WALK}
select path[i] as ancestor, node, (len(path) - i)::bigint as distance
from (select node, path, unnest(range(1, len(path))) as i from tree where len(path) > 1)""",
    "p1_cycles": f"""with recursive {_WALK}, {_CIRCLES}
select s.node as revision_id, s.parent as parent_id, l.circle as circle_id from stuck s join low l on l.node = s.node""",
}

# Each node's way up until it meets a node again; ``seen`` is the way so far.
_UP = f"""{_FOREST},
up(node, spot, seen) as (select node, node, [node] from forest union all
  select u.node, f.parent, list_append(u.seen, f.parent) from up u join forest f on f.node = u.spot where f.parent is not null and not list_contains(u.seen, f.parent))"""

ORACLE |= {
    "p1_paths_all": f"""with recursive {_UP},
ring as (select distinct u.node as id from up u join forest f on f.node = u.spot where f.parent = u.node),
met as (select node, arg_min(seen, len(seen)) as seen, min(spot) as circle from up where spot in (select id from ring) group by node),
free as (select node, arg_max(seen, len(seen)) as seen from up group by node),
below as (select spot as node, count(*) as n from up where spot <> node group by spot)
select f.node as revision_id, list_reverse(coalesce(m.seen, f.seen)) as path, coalesce(b.n, 0)::bigint as descendants, m.circle as circle_id
from free f left join met m on m.node = f.node left join below b on b.node = f.node""",
    "p1_descendants_all": f"""with recursive {_UP}
select spot as ancestor, node, (len(seen) - 1)::bigint as distance from up where spot <> node""",
}

_DOCS = """raw as (select 'diff' as holder, revision_id, coalesce(parent_id, 0)::bigint as parent_id, diff as t from diffs
  union all select 'snapshot', id, 0::bigint, snapshot from revisions),
docs as (select distinct holder, revision_id, parent_id, t::json as j from (select * from raw where json_valid(t))),
els as (select holder, revision_id, parent_id, i::bigint as diff_no, l[i + 1] as e from (
  select *, unnest(range(len(l))) as i from (
    select *, case when json_type(j) = 'ARRAY' then json_extract(j, '$[*]') else [j] end as l from docs))),
typed as (select *, json_type(e) = 'OBJECT' as obj, json_type(e) = 'OBJECT' and not list_has_any(json_keys(e), ['ops', 'positions']) as bare from els),
opl as (select *, case when bare then [e] when obj and json_type(e, '$.ops') = 'ARRAY' then json_extract(e, '$.ops[*]') else [] end as ol,
  case when obj and not bare and json_type(e, '$.positions') = 'ARRAY' then json_extract(e, '$.positions[*]') else [] end as pl from typed),
ops as (select holder, revision_id, parent_id, diff_no, i::bigint as op_no, ol[i + 1] as op from (select *, unnest(range(len(ol))) as i from opl)),
aggs as (select *, unnest(json_keys(op)) as aggregation from ops where json_type(op) = 'OBJECT'),
sides as (select *, unnest(['added', 'removed']) as change from aggs),
lists as (select *, case when json_type(op -> aggregation -> change) = 'ARRAY' then json_extract(op -> aggregation -> change, '$[*]') else [] end as cl from sides),
entries as (select *, cl[i + 1] as c, i::bigint as entry_no from (select *, unnest(range(len(cl))) as i from lists)),
chunks as (select *, try_cast(json_extract_string(c, '$.id') as bigint) as chunk_id from entries where json_type(c) = 'OBJECT')"""

_HEAD = "holder, revision_id, parent_id, diff_no, op_no, aggregation, change, entry_no, chunk_id"
_ORDERED = f"""{_LEVELS}, {_DOCS},
placed as (select c.*, coalesce(a.level, b.level + 1) as at_level from chunks c left join lv a on a.id = c.revision_id left join lv b on b.id = c.parent_id
  where holder = 'diff' and c.revision_id is not null and chunk_id is not null),
ordered as (select *, row(at_level, revision_id, parent_id, diff_no, op_no, (change = 'added')::int) as seq from placed where at_level is not null)"""

ORACLE |= {
    "p2_found": f"""with {_ORDERED}
select chunk_id, revision_id from (select *, row_number() over (partition by chunk_id order by seq desc) as rn from ordered) where rn = 1 and change = 'added'""",
    "p2_state": f"""with {_ORDERED},
cut as (select chunk_id, max(seq) as last, max(seq) filter (where change = 'removed') as gone from ordered group by chunk_id),
kept as (select o.*, case when json_type(c, '$.min') = 'ARRAY' then array_to_string(json_extract_string(c, '$.min[*]'), '|') end as mn,
    case when json_type(c, '$.max') = 'ARRAY' then array_to_string(json_extract_string(c, '$.max[*]'), '|') end as mx, try_cast(json_extract_string(c, '$.count') as bigint) as n
  from ordered o join cut k using (chunk_id) where (k.gone is null or o.seq > k.gone) and k.last is distinct from k.gone)
select chunk_id, arg_max(revision_id, seq) as revision_id,
  arg_max(mn, row(seq, mn)) filter (where mn is not null) as min_key, arg_max(mx, row(seq, mx)) filter (where mx is not null) as max_key,
  arg_max(n, row(seq, n)) filter (where n is not null) as n_rows from kept group by chunk_id""",
    "p2_state_all": f"""with {_ORDERED},
cut as (select chunk_id, max(seq) as last, max(seq) filter (where change = 'removed') as gone from ordered group by chunk_id),
kept as (select o.*, case when json_type(c, '$.min') = 'ARRAY' then array_to_string(json_extract_string(c, '$.min[*]'), '|') end as mn,
    case when json_type(c, '$.max') = 'ARRAY' then array_to_string(json_extract_string(c, '$.max[*]'), '|') end as mx, try_cast(json_extract_string(c, '$.count') as bigint) as n,
    case when json_type(c, '$.measures') = 'ARRAY' then json_extract_string(c, '$.measures[*]') end as ms, json_extract_string(c, '$.meta.node') as nd,
    case when json_type(c, '$.meta.tags') = 'ARRAY' then list_transform(json_extract(c, '$.meta.tags[*]'), lambda t: row(json_extract_string(t, '$.k'), json_extract_string(t, '$.v'))) end as tg
  from ordered o join cut k using (chunk_id) where (k.gone is null or o.seq > k.gone) and k.last is distinct from k.gone),
whole as (select chunk_id, arg_max(revision_id, seq) as revision_id,
  arg_max(mn, row(seq, mn)) filter (where mn is not null) as min_key, arg_max(mx, row(seq, mx)) filter (where mx is not null) as max_key,
  arg_max(n, row(seq, n)) filter (where n is not null) as n_rows, arg_max(ms, row(seq, ms)) filter (where ms is not null) as measures,
  arg_max(nd, row(seq, nd)) filter (where nd is not null) as node, arg_max(tg, row(seq, tg)) filter (where tg is not null) as tags from kept group by chunk_id)
select * exclude (tags), list_transform(tags, lambda t: t[1]) as tag_keys, list_transform(tags, lambda t: t[2]) as tag_values from whole""",
    "p3_found": f"with {_DOCS} select distinct {_HEAD} from chunks where chunk_id is not null",
    "p3_positions": f"""with {_DOCS} select distinct holder, revision_id, parent_id, diff_no, i::bigint as position_no, json_extract_string(p, '$.log') as log,
  json_extract_string(p, '$.from[0]') as from_file, try_cast(json_extract_string(p, '$.from[1]') as bigint) as from_remainder, try_cast(json_extract_string(p, '$.from[2]') as bigint) as from_position,
  json_extract_string(p, '$.to[0]') as to_file, try_cast(json_extract_string(p, '$.to[1]') as bigint) as to_remainder, try_cast(json_extract_string(p, '$.to[2]') as bigint) as to_position
  from (select *, pl[i + 1] as p from (select *, unnest(range(len(pl))) as i from opl))""",
    "p3_log_diffs": f"with {_DOCS} select distinct holder, revision_id, parent_id, diff_no, bare, len(pl)::int as n_positions, len(ol)::int as n_ops from opl where obj",
    "p3_ops": f"""with {_DOCS} select distinct holder, revision_id, parent_id, diff_no, op_no, aggregation,
  coalesce(json_array_length(op -> aggregation -> 'added'), 0)::int as n_added, coalesce(json_array_length(op -> aggregation -> 'removed'), 0)::int as n_removed from aggs""",
    "p3_measures": f"""with {_DOCS} select distinct {_HEAD}, k::bigint as measure_no, ml[k + 1] as measure from (select *, unnest(range(len(ml))) as k from (
  select *, case when json_type(c, '$.measures') = 'ARRAY' then json_extract_string(c, '$.measures[*]') else [] end as ml from chunks where chunk_id is not null))""",
    "p3_tags": f"""with {_DOCS} select distinct {_HEAD}, n::bigint as tag_no, json_extract_string(tl[n + 1], '$.k') as k, json_extract_string(tl[n + 1], '$.v') as v from (select *, unnest(range(len(tl))) as n from (
  select *, case when json_type(c, '$.meta.tags') = 'ARRAY' then json_extract(c, '$.meta.tags[*]') else [] end as tl from chunks where chunk_id is not null))""",
    "p4_found": """with ok as (select run_id, cutoff_at, row_number() over (order by cutoff_at, run_id) as n from processor_runs where status = 'ok' and cutoff_at is not null and run_id is not null),
seen as (select r.id, o.n, r.level, r.snapshot, r.type, r.created_by, row_number() over (partition by r.id, o.n
    order by coalesce(r.timestamp, r.loaded_at) desc, r.loaded_at desc, r.level desc nulls last, r.snapshot desc nulls last, r.type desc nulls last, r.created_by desc nulls last) as rn
  from revisions r join ok o on r.loaded_at <= o.cutoff_at where r.id is not null),
now as (select * from seen where rn = 1)
select o.run_id, a.id from now a join ok o on o.n = a.n left join now b on b.id = a.id and b.n = a.n - 1
where b.id is null or (a.level, a.snapshot, a.type, a.created_by) is distinct from (b.level, b.snapshot, b.type, b.created_by)""",
}

_REFS = """links as (select revision_id, coalesce(parent_id, 0)::bigint as parent_id, min(received_at) as t from diffs where revision_id is not null group by all),
refs as (select 'revision_id' as ref_column, revision_id as key, * from links union all select 'parent_id', parent_id, * from links where parent_id <> 0),
lo as (select id, min(loaded_at) as first_loaded, max(loaded_at) as last_loaded from revisions group by id),
cl as (select revision_id as id, max(cleaned_at) as last_cleaned from cleanup_log group by revision_id),
found as (select r.*, case when lo.id is null then 'missing' when lo.last_loaded < cl.last_cleaned then 'deleted' when lo.first_loaded > r.t then 'late' end as reason
  from refs r left join lo on lo.id = r.key left join cl on cl.id = r.key where r.key not in (select id from revisions_backup where id is not null)),
direct as (select ref_column, revision_id, parent_id, reason, strftime(t, '%Y-%m') as period from found where reason is not null)"""

ORACLE |= {
    "p5_found": f"with {_REFS} select * from direct",
    "p5_report": f"""with recursive {_REFS},
bad(id) as (select distinct revision_id from direct union select l.revision_id from links l join bad b on l.parent_id = b.id),
report as (select 'direct' as kind, ref_column, reason, period from direct union all
  select 'inherited', 'parent_id', 'inherited', strftime(t, '%Y-%m') from links l where l.parent_id in (select id from bad)
    and not exists (select 1 from direct x where x.ref_column = 'parent_id' and x.revision_id = l.revision_id and x.parent_id = l.parent_id))
select kind, ref_column, reason, period, count(*) as n from report group by all""",
}
