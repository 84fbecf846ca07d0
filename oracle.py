"""The SQL that states, independently of the library, what every query must return."""

from __future__ import annotations

# Expressions below run unchanged in both engines.
SOURCE = "'E' || lpad(cast(user_id % 7 as string), 2, '0') || '.gz'"

ADDRESS = """case event_id % 16
  when 0 then '-'
  when 1 then '2001:0DB8:' || cast(user_id % 10000 as string) || '::' || cast(event_id % 10 as string)
  when 2 then '::ffff:10.' || cast(user_id % 256 as string) || '.1.2'
  when 3 then 'FE80::' || cast(event_id % 1000 as string) || '%eth0'
  when 4 then '::1:2:3:4:5:6:' || cast(user_id % 1000 as string)
  when 5 then '0:' || cast(event_id % 10000 as string) || ':0:0:0:0:0:1'
  when 6 then '2A02:' || lpad(cast(event_id % 100 as string), 4, '0') || '::'
  when 7 then '300.1.1.' || cast(user_id % 256 as string)
  when 8 then '10.' || cast(event_id % 256 as string) || '.3'
  when 9 then '203.0.113.7, 10.0.0.1'
  when 10 then '1:2:3:4:5:6:7:8:' || cast(user_id % 10 as string)
  when 11 then ''
  when 12 then '::1:2:3:4:5:6:7:' || cast(user_id % 10 as string)
  else cast(user_id % 256 as string) || '.' || cast(event_id % 256 as string) || '.0.' || cast(event_id % 300 as string)
end"""

# The name of an event's raw file, and a message about an object of a given key.
RAW_NAME = "'E' || lpad(cast(user_id % 7 as string), 2, '0') || '-' || cast(event_id div 5000 as string)"
KEY_MESSAGE = """'{"Records":[{"eventName":"ObjectCreated:Put","s3":{"bucket":{"name":"logs"},"object":{"key":"' || key || '"}}}]}'"""

# Fields that are absent or do not fit, by position.
DIRT = {
    "sc_bytes": "case when pos % 13 = 0 then '-' else sc_bytes end",
    "status": "case when pos % 29 = 0 then '99999' else status end",
    "time_taken": "case when pos % 31 = 0 then '1.5f' else time_taken end",
    "cs_uri_stem": "case when pos % 37 = 0 then '-' else cs_uri_stem end",
    "cs_method": "case when pos % 41 = 0 then repeat('G', 300) else cs_method end",
    "time": "case when pos % 43 = 0 then '25:00:00' else time end",
}

MESSAGE = """case when event_id % 13 = 0 then 'not json'
  when event_id % 17 = 0 then '{"Event":"s3:TestEvent"}'
  else '{"Records":[{"eventName":"' || case when event_id % 5 = 0 then 'ObjectRemoved:Delete' else 'ObjectCreated:Put' end
   || '","s3":{"bucket":{"name":"' || case when event_id % 7 = 0 then 'other' else 'logs' end
   || '"},"object":{"key":"masked/' || cast(event_id % 40 as string) || '/E' || cast(user_id % 7 as string) || '.gz"}}}]}'
  end"""

# Messages of every shape, each with what is wrong with it, by event.
NOTICES = [
    ("null", "no body"),
    ("'not json'", "not json"),
    ("'{\"Event\":\"s3:TestEvent\"}'", "no records"),
    ("'[]'", "no records"),
    ("'{\"Records\":[]}'", "no entries"),
    ("'{\"Records\":[{\"eventName\":\"ObjectRemoved:Delete\",\"s3\":{\"bucket\":{\"name\":\"logs\"},\"object\":{\"key\":\"raw/a\"}}}]}'", "other event"),
    ("'{\"Records\":[{\"s3\":{\"bucket\":{\"name\":\"logs\"},\"object\":{\"key\":\"raw/a\"}}}]}'", "other event"),
    ("'{\"Records\":[{\"eventName\":\"ObjectCreated:Put\"}]}'", "no object"),
    ("'{\"Records\":[{\"eventName\":\"ObjectCreated:Put\",\"s3\":{\"object\":{\"key\":\"raw/a\"}}}]}'", "no bucket"),
    ("'{\"Records\":[{\"eventName\":\"ObjectCreated:Put\",\"s3\":{\"bucket\":{\"name\":\"other\"},\"object\":{\"key\":\"raw/a\"}}}]}'", "other bucket"),
    ("'{\"Records\":[{\"eventName\":\"ObjectCreated:Put\",\"s3\":{\"bucket\":{\"name\":\"logs\"},\"object\":{}}}]}'", "no key"),
    ("'{\"Records\":[{\"eventName\":\"ObjectCreated:Put\",\"s3\":{\"bucket\":{\"name\":\"logs\"},\"object\":{\"key\":\"etc/a\"}}}]}'", "other prefix"),
    ("'{\"Records\":[{\"eventName\":\"ObjectCreated:Put\",\"s3\":{\"bucket\":{\"name\":\"logs\"},\"object\":{\"key\":\"raw/' || user_id || '\"}}}]}'", None),
]
NOTICE = "case event_id % 13 " + " ".join(f"when {i} then {body}" for i, (body, _) in enumerate(NOTICES)) + " end"
_NOTICE_REASON = "case event_id % 13 " + " ".join(f"when {i} then '{r}'" for i, (_, r) in enumerate(NOTICES) if r) + " end"

# Record dates as written by careless writers: unpadded, impossible, or no date at all.
_RAW_DATE = """case when event_id % 97 = 0 then 'bad' when event_id % 89 = 0 then '2024-02-30'
  when event_id % 5 = 0 then {short} else {long} end"""
SPARK_RAW_DATE = _RAW_DATE.format(short="date_format(ts, 'yyyy-M-d')", long="date_format(ts, 'yyyy-MM-dd')")

_ISO_TIME = """{text} || case event_id % 3 when 0 then 'Z' when 1 then '+09:00' else '-08:00' end"""
SPARK_ISO_TIME = _ISO_TIME.format(text="date_format(ts, \"yyyy-MM-dd'T'HH:mm:ss\")")

_OCTET = "(25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
_QUAD = f"{_OCTET}([.]{_OCTET}){{3}}"

# Addresses are judged and cut by expanding them to their eight groups.
_MASK_IPS = f"""
with a as (select event_id, {ADDRESS} as addr from events),
t as (select *, regexp_replace(lower(regexp_replace(addr, '%[^%/]+$', '')), ':{_QUAD}$', ':0:0') as u from a),
h as (select *, list_filter(string_split(split_part(u, '::', 1), ':'), lambda g: g <> '') as l,
   list_filter(string_split(split_part(u, '::', 2), ':'), lambda g: g <> '') as r,
   (length(u) - length(replace(u, '::', ''))) / 2 as gaps from t),
e as (select *, len(l) + len(r) as n, list_concat(l, list_concat(
   case when gaps = 1 then list_transform(range(8 - len(l) - len(r)), lambda i: '0') else [] end, r)) as g from h),
v as (select *,
   regexp_full_match(addr, '{_QUAD}') as v4,
   regexp_full_match(u, '[0-9a-f:]+') and contains(u, ':') and not contains(u, ':::')
   and len(list_filter(g, lambda x: length(x) > 4)) = 0
   and ((gaps = 1 and n <= 7 and (len(l) = 0 or not starts_with(u, ':')))
     or (gaps = 0 and n = 8 and not starts_with(u, ':') and not ends_with(u, ':'))) as v6 from e),
m as (select *, ltrim(g[1], '0') as g1, ltrim(g[2], '0') as g2 from v)
select event_id,
 case when addr = '-' then '-' when v4 then split_part(addr, '.', 1) || '.0.0.0'
   when v6 and g1 = '' and g2 = '' then '::' when v6 and g2 = '' then g1 || '::'
   when v6 then (case when g1 = '' then '0' else g1 end) || ':' || g2 || '::' end as masked_ip,
 case when addr <> '-' then v4 or v6 end as valid
from m"""

# The access-log view of events, masked and numbered.
_FIX = f"""fix as (
select {SOURCE} as src_file, event_id as pos, cast(ts as date) as log_date, strftime(ts, '%H:%M:%S') as log_time,
 'E' || lpad(cast(user_id % 7 as string), 2, '0') || '-' || cast(event_id // 5000 as string) as src,
 cast(strftime(ts, '%Y-%m-%d %H:%M:%S') as timestamp) as datetime,
 'EDG' || cast(user_id % 12 as string) as edge_location,
 cast(floor(value * 100) as bigint) as sc_bytes,
 case when event_id % 50 = 0 then '-'
   when event_id % 10 = 1 then '2001:db8:' || cast(1000 + user_id as string) || '::' || cast(event_id % 10 as string)
   else cast(1 + user_id % 223 as string) || '.' || cast(event_id % 256 as string) || '.'
     || cast(user_id % 256 as string) || '.' || cast(1 + event_id % 250 as string) end as c_ip,
 case when event_type = 'purchase' then 'POST' else 'GET' end as cs_method,
 '/' || event_type || '/' || regexp_extract(props, '([0-9]+)', 1) as cs_uri_stem,
 cast(case when event_type = 'error' then 500 when event_id % 20 = 0 then 304 else 200 end as smallint) as status,
 case when event_id % 3 = 0 then '-' else 'https://ref' || cast(user_id % 40 as string) || '.example.com/' end as referer,
 case when event_id % 11 = 0 then '-' else 'agent/' || cast(user_id % 60 as string) end as user_agent,
 'https' as cs_protocol, cast(100 + event_id % 900 as bigint) as cs_bytes,
 cast(cast(value / 1000 as real) as double) as time_taken,
 case when event_type = 'error' then 'Error' when event_id % 2 = 0 then 'Hit' else 'Miss' end
   as edge_response_result_type,
 cast(cast(value / 2000 as real) as double) as time_to_first_byte
from events)"""

_MASKED = f"""{_FIX}, masked as (
select *, case when c_ip = '-' then '-'
   when c_ip like '%:%' then regexp_extract(c_ip, '^([0-9a-f]+:[0-9a-f]+):', 1) || '::'
   else regexp_extract(c_ip, '^([0-9]+)[.]', 1) || '.0.0.0' end as masked_ip,
 cast(row_number() over (partition by src_file, log_date order by pos) as int) as seq_num,
 cast(row_number() over (partition by src, log_date order by pos) as int) as file_row_num
from fix)"""

_DIMENSIONS = {
    "referer": "referer",
    "page": "cs_uri_stem",
    "edge_location": "edge_location",
    "user_agent": "user_agent",
    "result_type": "edge_response_result_type",
}

_KEYS = " union all ".join(
    f"select '{dim}' as dim, {column} as key, status, datetime, log_date from masked"
    for dim, column in _DIMENSIONS.items()
)

_DIMS = f"""{_MASKED}, keys as ({_KEYS}), dims as (
select dim, key, cast(row_number() over (partition by dim order by key) as bigint) as id
from (select distinct dim, key from keys) d)"""

# Dimensions after a load of the first day and one of the others.
_TWO_LOADS = f"""with {_MASKED}, keys as ({_KEYS}),
firsts as (select dim, key, case when min(log_date) = date '2024-01-01' then 1 else 2 end as load from keys group by dim, key)
select dim, key, cast(row_number() over (partition by dim order by load, key) as bigint) as id from firsts"""

_STAGE_COLUMNS = """datetime, seq_num, edge_location, sc_bytes, cs_method, cs_uri_stem, status, referer,
 user_agent, cs_protocol, cs_bytes, time_taken, edge_response_result_type, time_to_first_byte"""

_FACT = f"""{_DIMS}, fact as (
select m.datetime, m.seq_num, cast(e.id as int) as edge_location, m.sc_bytes, m.cs_method, cast(p.id as int) as page,
 m.status, r.id as referer, u.id as user_agent, m.cs_protocol, m.cs_bytes, m.time_taken,
 cast(t.id as int) as edge_response_result_type, m.time_to_first_byte, m.log_date
from masked m
join dims e on e.dim = 'edge_location' and e.key = m.edge_location
join dims p on p.dim = 'page' and p.key = m.cs_uri_stem
join dims r on r.dim = 'referer' and r.key = m.referer
join dims u on u.dim = 'user_agent' and u.key = m.user_agent
join dims t on t.dim = 'result_type' and t.key = m.edge_response_result_type)"""

_FACT_ROWS = f"with {_FACT} select * exclude (log_date) from fact"

_FILE_ROWS = f"""with {_MASKED}
select src, log_date, file_row_num as row_num, log_time as time, masked_ip as c_ip, cs_uri_stem, sc_bytes from masked"""

# Locations: the path of a URL, its fragment, query, folder and last segment.
_PARTS = """with u as (select page_id, regexp_replace(url, '^[a-z]+://[^/?#]*', '') as uri from pages),
f as (select *, regexp_extract(uri, '(#.*)$', 1) as fragment, regexp_extract(uri, '^([^#]*)', 1) as rest from u),
q as (select *, regexp_extract(rest, '([?].*)$', 1) as query, regexp_extract(rest, '^([^?]*)', 1) as path from f),
s as (select *, regexp_extract(path, '(/[^/]*)$', 1) as segment from q),
parts as (select *, substr(path, 1, length(path) - length(segment)) as folder from s)"""


_BAD = """case when pos % 43 = 0 then 'no valid datetime' when pos % 13 = 0 then 'bad value in sc_bytes'
 when pos % 37 = 0 then 'no cs_uri_stem'
 when pos % 29 = 0 then 'bad value in status' when pos % 31 = 0 then 'bad value in time_taken'
 when pos % 41 = 0 then 'cs_method is too long' end"""


def _new_keys(dim: str) -> str:
    return f"""with {_MASKED}, keys as ({_KEYS})
select key, count(*) as n_rows from keys where dim = '{dim}' and key not in (
  select key from keys where dim = '{dim}' and status = 500 and datetime < timestamp '2024-01-01 03:00:00')
group by key"""


def statements() -> dict[str, str]:
    return {
        "mask_ips": _MASK_IPS,
        "number_rows": f"with {_MASKED} select src_file, log_date, pos, seq_num as row_num, masked_ip as c_ip from masked",
        "route_by_date": f"""
with d as (select {SOURCE} as src_file, {_RAW_DATE.format(
            short="strftime(ts, '%Y-%-m-%-d')", long="strftime(ts, '%Y-%m-%d')")} as raw_date from events)
select src_file, coalesce(strftime(try_cast(raw_date as date), '%Y/%m/%d/'), 'rejected') as date_path,
 count(*) as n_rows from d group by 1, 2""",
        "mask_log_files": _FILE_ROWS,
        "stream_mask": _FILE_ROWS,
        "two_streams": _FILE_ROWS,
        "mixed_layouts": f"""with {_FIX}
select src, case when src >= 'E06' then 'no_header' end as reject, count(*) as n_rows from fix group by 1, 2""",
        "mask_bad_files": f"""with {_FIX}, bad as (select src, count(*) as n from fix where pos % 4001 = 7 group by src)
select src, 'bad_address' as reject, n as n_rows from bad
union all select src, null, count(*) from fix where src not in (select src from bad) group by src""",
        "mask_notified": f"""with {_FIX} select src, count(*) as n_rows from fix where pos // 5000 % 2 = 0 group by src""",
        "stream_notified": f"""with {_FIX} select src, count(*) as n_rows from fix where pos // 5000 % 2 = 0 group by src""",
        "notified_rejects": f"""with {_FIX}, names as (select distinct pos // 5000 as run, src from fix where pos // 5000 % 2 = 0)
select 'no records' as reason, count(*) as n_messages from names union all select 'other bucket', count(*) from names""",
        "message_rejects": f"""select event_id, cast(case when event_id % 13 >= 5 then 0 end as int) as entry, {_NOTICE_REASON} as reason
from events where event_id % 13 < 12""",
        "clean_up_notified": f"""with {_FIX} select distinct src from fix
where not (pos // 5000 % 2 = 0 and cast(substr(src, 2, 2) as bigint) % 3 <> 0)""",
        "resort_overlapping": f"""with {_FIX} select log_date, hour(datetime) >= 12 as late, count(*) as n_rows,
 count(*) filter (where hour(datetime) < 12) as kept_rows from fix group by all""",
        "load_indexed": _TWO_LOADS,
        "tsv_round_trip": f"with {_MASKED} select {_STAGE_COLUMNS} from masked",
        "retire_sources": f"""with {_FIX}
select src, count(*) as raw_rows, count(*) filter (where log_date <> date '2024-01-10') as masked_rows,
 cast(0 as bigint) as rejected_rows, count(*) filter (where log_date = date '2024-01-10') = 0 as done
from fix group by src""",
        "stage_day": f"with {_MASKED} select {_STAGE_COLUMNS}, src_file from masked",
        "quarantine_day": f"""with {_MASKED} select {_STAGE_COLUMNS}, src_file from masked where {_BAD} is null""",
        "load_reject_reasons": f"with {_MASKED} select src_file, seq_num, {_BAD} as reason from masked where {_BAD} is not null",
        "reload_rejected": f"""with {_FIX}
select log_date, case when day(log_date) % 3 = 0 and day(log_date) <> 3 then 'rejected' else 'loaded' end as kind,
 count(*) as n_rows from fix group by 1, 2""",
        "new_referers": _new_keys("referer"),
        "new_pages": _new_keys("page"),
        "new_edge_locations": _new_keys("edge_location"),
        "new_user_agents": _new_keys("user_agent"),
        "new_result_types": _new_keys("result_type"),
        "assign_dim_ids": f"with {_DIMS} select dim, key, id from dims",
        "encode_fact": _FACT_ROWS,
        "load_two_days": _TWO_LOADS,
        "reload_affected": f"""with {_FIX}
select log_date, count(*) as n_rows, cast(sum(sc_bytes) as bigint) as bytes from fix group by log_date""",
        "compact_fact": _FACT_ROWS,
        "compact_dims": f"with {_DIMS} select dim, key, id from dims",
        "unsorted_files": """select step || ' ' || name as checked, cast(0 as bigint) as n_wrong
from unnest(['loaded', 'compacted']) as a(step),
 unnest(['access_log', 'referer', 'page', 'edge_location', 'user_agent', 'result_type']) as b(name)""",
        "dim_uniqueness": f"""with {_DIMS}
select dim, 'key' as what, key as value, cast(2 as bigint) as n from dims where dim = 'page' and key like '/view/%'
union all select dim, 'id', cast(id as string), cast(2 as bigint) from dims where dim = 'result_type' and key = 'Hit'""",
        "fact_orphans": f"""with {_DIMS}, uses as (
select d.dim, d.id from dims d join keys k on k.dim = d.dim and k.key = d.key
where d.key = 'Error' or d.key like '/click/%')
select dim, id, count(*) as n from uses group by dim, id""",
        "not_null_violations": f"""with {_FIX}
select 'cs_method' as column_name, count(*) as violations from fix where status = 500
union all select 'sc_bytes', count(*) from fix where status = 304""",
        "length_violations": f"""with {_FIX}
select 'cs_uri_stem' as column_name, count(*) as violations from fix where 200 * strlen(cs_uri_stem) > 2048
union all select 'referer', count(*) from fix where referer <> '-'""",
        "observed_checks": f"""with {_FIX}
select 'length' as check, 'cs_uri_stem' as subject, count(*) as violations from fix where 200 * strlen(cs_uri_stem) > 2048
union all select 'length', 'referer', count(*) from fix where referer <> '-'
union all select 'null', 'cs_method', count(*) from fix where cs_method = 'POST'
union all select 'null', 'sc_bytes', count(*) from fix where status = 304
union all select 'lost rows', 'access_log', count(*) from fix where edge_response_result_type = 'Error'""",
        "load_checks": f"""with {_FIX}, days as (select count(distinct log_date) as n from fix)
select kind as check, cast(2 * subjects as bigint) as n_checks, cast(0 as bigint) as violations, cast(subjects * n as bigint) as n_days
from days, (values ('length', 5), ('null', 13), ('lost rows', 1)) as kinds(kind, subjects)""",
        "expand_page_urls": f"""{_PARTS}
select page_id, folder || case when instr(segment, '.') > 0 then segment
  when segment like '%/' then segment || 'index.html' else segment || '/index.html' end || query || fragment as expanded
from parts""",
        "split_url_parts": f"{_PARTS} select page_id, fragment, query, folder, segment from parts",
        "created_object_keys": f"""with m as (select {MESSAGE} as body from events)
select distinct regexp_extract(body, '"key":"([^"]*)"', 1) as object_key from m
where body like '%"ObjectCreated:%' and body like '%"name":"logs"%'""",
        "finished_source_keys": f"""with m as (select {MESSAGE} as body from events)
select distinct regexp_extract(body, '"key":"masked/1[^"]*/([^"/]+)"', 1) as source_key from m
where body like '%"ObjectCreated:%' and body like '%"name":"logs"%' and body like '%"key":"masked/1%'""",
        "target_day": f"""with t as (select event_id, {_ISO_TIME.format(text="strftime(ts, '%Y-%m-%dT%H:%M:%S')")} as time
from events) select event_id, cast(cast(substr(time, 1, 10) as date) - 1 as date) as target_day from t""",
        "decode_star": f"with {_MASKED} select {_STAGE_COLUMNS} from masked",
        "decode_nulls": f"""with {_MASKED} select {_STAGE_COLUMNS.replace("referer", "case when status <> 304 then referer end as referer")
            .replace("edge_response_result_type", "nullif(edge_response_result_type, 'Error') as edge_response_result_type")}
from masked""",
        "daily_page_views": f"""with {_FIX}
select log_date, cs_uri_stem as path, count(*) as views, cast(sum(sc_bytes) as bigint) as bytes from fix group by 1, 2""",
        "maintained_page_views": f"""with {_FIX}
select cs_uri_stem as path, count(*) as views, cast(sum(sc_bytes) as bigint) as bytes, count(distinct user_agent) as agents
from fix where src_file < 'E04' or day(log_date) > 2 group by 1""",
        "result_mix": f"""with {_FIX}
select edge_response_result_type as result_type, status, count(*) as requests from fix group by 1, 2""",
    }
