"""The same queries as SQL over the given tables."""

from __future__ import annotations

CMD = """select event_id::varchar as reservation_id, user_id as event_id, event_type as section,
  (floor(value)::int % 4 + 1)::int as seat_count, regexp_extract(props, '"k": ([0-9]+)', 1) as user_id, ts from events"""
INITS = f"""select distinct event_id, section, 4 as rows_n, 6 as per_row, timestamp '2023-12-31 00:00:00' as ts
  from ({CMD})"""
VENUE = """select n_nationkey::bigint as id, n_name as name, r_name as address, ((n_regionkey + 1) * 1000)::int as capacity
  from nation join region on n_regionkey = r_regionkey"""
EVENT = """select p_partkey as id, p_name as name, p_type as description,
  (date '2024-02-01' + p_size)::date as event_date, p_partkey % 25 as venue_id from part"""
TICKET = """select o_orderkey as id, o_custkey as event_id, 'A-' || (o_orderkey % 24 + 1) as seat_number,
  case o_orderstatus when 'O' then 'AVAILABLE' when 'P' then 'RESERVED' when 'F' then 'SOLD' end as status,
  o_totalprice::decimal(12,2) as price from orders"""
RESERVATION = """select event_id as id, event_id as ticket_id, user_id::varchar as user_id,
  case event_type when 'purchase' then 'CONFIRMED' when 'error' then 'CANCELLED' else 'PENDING' end as status,
  ts as created_at from events"""
LOG = """select event_id as request_id, floor(value * 3)::bigint as post_ms, floor(value * 7)::bigint as get_ms,
  floor(value * 3)::bigint + floor(value * 7)::bigint + event_id % 100 as latency_ms, event_type <> 'error' as ok from events"""
AREAS = """select p_partkey as event_id, p_name as event_name, p_brand as artist, chr(64 + i::int) as area_id,
  (p_size % 7)::int as row_count, (p_size + i)::int as col_count
  from part, lateral (select unnest(range(1, p_size % 4 + 2)) as i)"""
EVENT_VIEW = f"""select e.id, e.name, e.description, e.event_date, e.venue_id, v.name as venue_name,
  null::int as total_seats from ({EVENT}) e join ({VENUE}) v on v.id = e.venue_id"""
TICKET_VIEW = f"""select t.id, t.event_id, e.name as event_name, t.seat_number, t.status, t.price
  from ({TICKET}) t join ({EVENT}) e on e.id = t.event_id"""


def fold(name: str, commands: str, sections: str = "true", seats: int = 24) -> str:
    """CTEs replaying ``commands``: ``<name>`` has one row per set-up (rn 0) and command of the chosen sections."""
    return f"""{name}_c as (select *, row_number() over (partition by event_id, section order by ts, reservation_id) as rn
  from ({commands})),
{name} as (
  select distinct event_id, section, 0::bigint as rn, list_filter(range(1, {seats + 1}), lambda x: x % 7 <> 0) as fr,
    null::varchar as reservation_id, null::int as seat_count, null::varchar as user_id,
    timestamp '2023-12-31 00:00:00' as ts, null::bigint as f from ({CMD}) where {sections}
  union all
  select event_id, section, rn, case when f is null then fr else list_filter(fr, lambda x: x < f or x >= f + seat_count) end,
    reservation_id, seat_count, user_id, ts, f
  from (select s.event_id, s.section, c.rn, s.fr, c.reservation_id, c.seat_count, c.user_id, c.ts,
      list_min(list_filter(s.fr, lambda x, i: i + c.seat_count - 1 <= len(s.fr)
        and s.fr[i + c.seat_count - 1] = x + c.seat_count - 1)) as f
    from {name} s join {name}_c c on c.event_id = s.event_id and c.section = s.section and c.rn = s.rn + 1))"""


ONE = "with recursive " + fold("st", CMD)
RESULT_COLUMNS = """reservation_id, event_id, section, seat_count, user_id,
  case when f is null then 'REJECTED' else 'CONFIRMED' end as status, f::int as first_seat, ts as completed_ts"""
RESULTS = f"res as (select {RESULT_COLUMNS}, 1::bigint as epoch from st where rn > 0)"
TAKEN = "taken as (select event_id, section, reservation_id, unnest(range(first_seat, first_seat + seat_count))::int as seat_no from res where first_seat is not null)"
SEATS = f"""inv as (select event_id, section, n::int as seat_no, section || '-' || n as seat,
  case when n % 7 = 0 then 'RESERVED' else 'AVAILABLE' end as status
  from ({INITS}), lateral (select unnest(range(1, rows_n * per_row + 1)) as n))"""
FINAL = """fin as (select i.event_id, i.section, i.seat_no, i.seat,
  case when t.seat_no is not null then 'RESERVED' else i.status end as status
  from inv i left join (select distinct event_id, section, seat_no from taken) t
    on t.event_id = i.event_id and t.section = i.section and t.seat_no = i.seat_no)"""
RUNS = """runs as (select event_id, section, min(seat_no)::int as run_start, count(*)::int as run_length
  from (select *, seat_no - row_number() over (partition by event_id, section order by seat_no) as island
    from fin where status = 'AVAILABLE') group by event_id, section, island)"""
ALL = ",\n".join([ONE, RESULTS, TAKEN, SEATS, FINAL, RUNS])
NAMED = "named as (select *, case when first_seat is null then '' else array_to_string(list_transform(range(first_seat, first_seat + seat_count), lambda n: section || '-' || n), ',') end as allocated_seats from res)"
CUT = "timestamp '2024-01-16 00:00:00'"
EARLY = "with recursive " + fold("st1", f"select * from ({CMD}) where ts < {CUT}") + """,
snap as (select event_id, section, arg_max(len(fr), rn) as available from st1 group by event_id, section)"""
KEY = "concat_ws('-', event_id, section) as section_key"


def judged(snapshot: str) -> str:
    return f"""judged as (select c.*, s.available is null or s.available >= c.seat_count as enough
  from ({CMD}) c left join ({snapshot}) s on s.event_id = c.event_id and s.section = c.section where c.ts >= {CUT})"""


WITHOUT_SIGNUP = judged("select * from snap where section <> 'signup'")
SECOND = fold("st2", f"select * from ({CMD}) where ts < {CUT} union all select * exclude (enough) from judged where enough")

# Sections of even events are set up anew at the cut, with 12 seats; those of every fifth event have no first set-up.
_OVER = f"(event_id % 2 = 0 and ts >= {CUT})"
REINIT = "with recursive " + fold("st1", f"select * from ({CMD}) where event_id % 5 <> 0 and not {_OVER}", "event_id % 5 <> 0") + (
    ", ") + fold("st2", f"select * from ({CMD}) where {_OVER}", "event_id % 2 = 0", 12) + f"""
select {RESULT_COLUMNS} from st1 where rn > 0 union all select {RESULT_COLUMNS} from st2 where rn > 0
union all select reservation_id, event_id, section, seat_count, user_id, 'REJECTED', null, ts
  from ({CMD}) where event_id % 5 = 0 and not {_OVER}"""
ASKED_EVENTS = "event_id in (select c_custkey * 3 from customer)"
SEAT_LIST = "case when first_seat is null then [] else list_transform(range(first_seat, first_seat + seat_count), lambda n: section || '-' || n) end"


def violations(rows: str) -> str:
    """Rows are (reservation_id, section, seat_count, status, seats)."""
    return f"""select reservation_id, problem from (select reservation_id, case
    when status not in ('CONFIRMED', 'REJECTED') then 'unknown status'
    when status = 'REJECTED' and len(seats) > 0 then 'seats on a rejection'
    when status = 'CONFIRMED' and len(seats) <> seat_count then 'wrong number of seats'
    when len(list_filter(seats, lambda s: s <> section || '-' || regexp_extract(s, '([0-9]+)$', 1))) > 0 then 'seat of another section'
    when len(list_filter(seats, lambda s, i: regexp_extract(s, '([0-9]+)$', 1)::int
      <> regexp_extract(seats[1], '([0-9]+)$', 1)::int + i - 1)) > 0 then 'seats not consecutive' end as problem
  from ({rows})) where problem is not null"""


def slo(get_most: int, least_rate: float) -> str:
    return f"""select *, p95_post_ms < 500 as post_ok, p95_get_ms < {get_most} as get_ok, pass_rate > {least_rate} as checks_ok from (
select count(*) as requests, count(*) filter (ok) as completed, avg(ok::int::double) as pass_rate,
  avg(latency_ms) filter (ok) as avg_duration_ms, (max(latency_ms) filter (ok))::bigint as max_duration_ms,
  quantile_cont(post_ms::double, 0.95) as p95_post_ms, quantile_cont(get_ms::double, 0.95) as p95_get_ms,
  quantile_cont(latency_ms::double, 0.95) filter (ok) as p95_duration_ms from ({LOG}))"""


TIMED = """select event_id as request_id, ts, floor(value * 3)::bigint + floor(value * 7)::bigint as processing_ms,
  floor(value * 3)::bigint + floor(value * 7)::bigint + event_id % 100 as latency_ms, event_type <> 'error' as ok from events"""


def alerts(closed: str) -> str:
    return f"""with w as (select date_trunc('hour', ts)::timestamp as window_start, date_trunc('hour', ts)::timestamp + interval 1 hour as window_end,
    count(*) as requests, count(*) filter (not ok) as timeouts, avg(latency_ms) as mean_ms from ({TIMED}) group by 1, 2),
  c as (select * from w where {closed})
select *, 'HighTimeoutRate' as alert, 'critical' as severity from c where timeouts > 0.05 * requests
union all select *, 'Slowdown', 'warning' from c where mean_ms > 50"""


ORACLE: dict[str, str] = {
    "src_commands": CMD,
    "src_section_init": f"""select event_id, section, rows_n as "rows", per_row as seats_per_row,
  section || '-7,' || section || '-14,' || section || '-21' as initial_reserved, ts from ({INITS})""",
    "wire_completions": f"""{ONE}, {RESULTS}, {NAMED} select reservation_id as "reservationId", event_id as "eventId", user_id as "userId", status,
  section, seat_count as "seatCount", allocated_seats as "allocatedSeats", epoch_us(completed_ts) // 1000 as "timestamp" from named""",
    "wire_states": f"{ALL} select * from runs",
    "section_key": f"select reservation_id, {KEY} from ({CMD})",
    "command_sequence": f"""select reservation_id, event_id, section,
  row_number() over (partition by event_id, section order by ts, reservation_id) as seq from ({CMD})""",
    "commands_of_requests": CMD,
    "live_request_ids": "select count(*) as requests, true as distinct_ids, true as well_formed from events",
    "seat_number": "select o_orderkey as id, (o_orderkey % 24 + 1)::int as number from orders",
    "epoch_round_trip": """select event_id::varchar as reservation_id, epoch_us(ts) // 1000 as millis,
  date_trunc('millisecond', ts) as instant, ts::date as day from events""",
    "seat_inventory": f"with {SEATS} select * from inv",
    "section_init_status": f"""with {SEATS} select event_id, section, count(*) filter (status = 'AVAILABLE')::int as available_count,
  timestamp '2023-12-31 00:00:00' as status_ts from inv group by event_id, section""",
    "publish_section_init": f"""select event_id || '-' || area_id as section_key, event_id, area_id as section, row_count as "rows",
  col_count as seats_per_row, 0::int as reserved from ({AREAS})""",
    "event_total_seats": f"select event_id, sum(row_count * col_count)::bigint as total_seats from ({AREAS}) group by event_id",
    "sections_from_tickets": f"""select event_id, split_part(seat_number, '-', 1) as section, 1::int as "rows", count(*)::int as seats_per_row,
  coalesce(string_agg(distinct seat_number, ',' order by seat_number) filter (status <> 'AVAILABLE'), '') as initial_reserved
  from ({TICKET}) group by event_id, split_part(seat_number, '-', 1)""",
    "seat_allocation": f"{ONE}, {RESULTS} select * from res",
    "seat_allocation_reinit": REINIT,
    "reservation_routing_reinit": REINIT,
    "section_status_changelog": f"""{ONE} select {KEY}, event_id, section, reservation_id, len(fr)::int as available_count,
  ts as status_ts from st""",
    "latest_section_status": f"""{ONE} select event_id, section, (arg_max(len(fr), rn) - 1)::int as available_count,
  max(ts) + interval 1 day as status_ts from st group by event_id, section""",
    "seat_inventory_final": f"{ALL} select * from fin",
    "available_seats": f"""{ALL} select event_id, section, count(*) filter (status = 'AVAILABLE')::int as available_count,
  coalesce(string_agg(seat, ',' order by seat_no) filter (status = 'AVAILABLE'), '') as available_seats
  from fin group by event_id, section""",
    "free_runs": f"{ALL} select * from runs",
    "first_fit_start": f"""{ALL} select c.event_id, c.section, c.seat_count, min(run_start)::int as first_seat
  from (select distinct event_id, section, seat_count from ({CMD})) c join runs r
    on r.event_id = c.event_id and r.section = c.section and r.run_length >= c.seat_count group by all""",
    "prefilter_accepted": f"""{EARLY}, {WITHOUT_SIGNUP} select {KEY}, * exclude (enough) from judged where enough
union all select {KEY}, * from ({CMD}) where ts < {CUT}""",
    "prefilter_rejected": f"""{EARLY}, {WITHOUT_SIGNUP} select reservation_id, event_id, section, seat_count, user_id,
  'REJECTED' as status, 0::int as seats, ts as completed_ts from judged where not enough""",
    "commands_with_status_as_of": f"""{ONE}, stood as (select event_id, section, ts as known_ts, arg_max(len(fr), rn)::int as known_available
    from st group by event_id, section, ts)
select c.reservation_id, c.event_id, c.section, c.seat_count, c.ts, s.known_available, s.known_ts
  from ({CMD}) c asof left join stood s on c.event_id = s.event_id and c.section = s.section and c.ts > s.known_ts""",
    "reservation_routing": f"""{EARLY}, {judged("select * from snap")}, {SECOND}
select {RESULT_COLUMNS}, false as prefiltered from st2 where rn > 0
union all select reservation_id, event_id, section, seat_count, user_id, 'REJECTED', null, ts, true from judged where not enough""",
    "reservation_table": f"""{ONE}, {RESULTS}, {NAMED} select reservation_id, event_id, section, seat_count, user_id, status,
  allocated_seats, completed_ts + interval 1 second as completed_ts from named""",
    "reservation_lookup": f"""{ONE}, {RESULTS}, {NAMED} select o_orderkey::varchar as asked_id, event_id, section, seat_count, user_id,
  status, allocated_seats, date_trunc('millisecond', completed_ts) as created_at, reservation_id is not null as found
  from orders left join named on reservation_id = o_orderkey::varchar""",
    "events_with_changes": f"{ONE}, {RESULTS} select distinct event_id from res where lower(status) = 'confirmed'",
    "status_feed": f"""{ONE}, {RESULTS} select event_id, section, len(fr)::int as available_count, ts as status_ts from st
  where event_id in (select event_id from res where status = 'CONFIRMED')""",
    "venues_all": VENUE,
    "events_all": EVENT_VIEW,
    "venue_by_id": f"""select asked_id, name, address, capacity, v.id is not null as found
  from (select distinct venue_id as asked_id from ({EVENT})) left join ({VENUE}) v on v.id = asked_id""",
    "event_by_id": f"""select asked_id, e.* exclude (id), e.id is not null as found
  from (select distinct c_custkey * 2 as asked_id from customer) left join ({EVENT_VIEW}) e on e.id = asked_id""",
    "ticket_by_id": f"""select asked_id, t.* exclude (id), t.id is not null as found
  from (select ticket_id * 2 as asked_id from ({RESERVATION})) left join ({TICKET_VIEW}) t on t.id = asked_id""",
    "tickets_by_event": f"select * from ({TICKET_VIEW}) where {ASKED_EVENTS}",
    "tickets_available": f"select * from ({TICKET_VIEW}) where status = 'AVAILABLE' and {ASKED_EVENTS}",
    "tickets_by_seats": f"""select t.* from ({TICKET}) t where exists (select 1 from ({CMD}) c
  where c.event_id = t.event_id and 'A-' || c.seat_count = t.seat_number)""",
    "reservation_by_ticket_user": f"""select r.* from ({RESERVATION}) r where exists (select 1 from ({CMD}) c
  where c.reservation_id::bigint = r.ticket_id and c.user_id = r.user_id)""",
    "ticket_has_active_reservation": f"""select id, exists (select 1 from ({RESERVATION}) r
  where r.ticket_id = t.id and r.status <> 'CANCELLED') as has_active from ({TICKET}) t""",
    "reservations_expanded": f"""select r.id, r.ticket_id, r.user_id, r.status, r.created_at, t.event_id, t.event_name, t.seat_number,
  t.status as ticket_status, t.price, e.event_date, e.venue_id, e.venue_name
  from ({RESERVATION}) r join ({TICKET_VIEW}) t on t.id = r.ticket_id join ({EVENT_VIEW}) e on e.id = t.event_id""",
    "ingest_events": f"""select e.id, e.name, e.venue_id, case when v.id is null then 'unknown parent' else 'accepted' end as verdict
  from (select id, name, case when id % 10 = 0 then venue_id + 1000000000 else venue_id end as venue_id from ({EVENT})) e
  left join ({VENUE}) v on v.id = e.venue_id""",
    "ingest_tickets": f"""select t.id, t.event_id, t.status, t.price, case when e.id is null then 'unknown parent'
    when t.status not in ('AVAILABLE', 'RESERVED', 'SOLD') then 'invalid status' else 'accepted' end as verdict
  from (select id, case when id % 10 = 0 then event_id + 1000000000 else event_id end as event_id,
    case when id % 13 = 0 then 'LOST' else status end as status, price from ({TICKET})) t
  left join ({EVENT}) e on e.id = t.event_id""",
    "compat_sections": f"""select event_id, event_name, artist, area_id as section, row_count as "rows",
  col_count as seats_per_row from ({AREAS})""",
    "compat_capacity": f"""select event_id, event_name, sum(row_count * col_count)::bigint as capacity
  from ({AREAS}) group by event_id, event_name""",
    "compat_reservations": f"""{ONE}, {RESULTS} select reservation_id, user_id, event_id::varchar as event_id, section as area_id,
  seat_count as num_of_seats, case status when 'CONFIRMED' then 'RESERVED' else status end as state,
  (case when first_seat is null then 0 else seat_count end)::int as seats,
  case when first_seat is null then '' else array_to_string(list_transform(range(first_seat, first_seat + seat_count), lambda n: ascii(section) - 65), ',') end as seat_rows,
  case when first_seat is null then '' else array_to_string(range(first_seat, first_seat + seat_count), ',') end as seat_cols
  from res""",
    "compat_resolve_event": f"""select q.reservation_id, q.section, q.seat_count, q.event_name, n.event_id, n.event_id is not null as accepted
  from (select c.reservation_id, c.section, c.seat_count,
      case when c.reservation_id::bigint % 10 = 0 then 'never registered' else p_name end as event_name
    from ({CMD}) c left join part on p_partkey = c.event_id) q
  left join (select p_name as event_name, max(p_partkey) as event_id from part group by p_name) n on n.event_name = q.event_name""",
    "compat_resolve_event_as_of": f"""with reg as (select split_part(p_name, ' ', 1) as event_name, max(p_partkey) as event_id,
    timestamp '2023-12-31 00:00:00' + to_days((p_partkey % 40)::int) as registered_ts from part group by 1, 3),
q as (select c.reservation_id, c.section, c.seat_count, c.ts, split_part(p_name, ' ', 1) as event_name
  from ({CMD}) c left join part on p_partkey = c.event_id)
select q.*, r.event_id, r.event_id is not null as accepted
  from q asof left join reg r on q.event_name = r.event_name and q.ts >= r.registered_ts""",
    "outcome_counts": f"""{ONE}, {RESULTS} select count(*) filter (ok and status = 'CONFIRMED') as successful,
  count(*) filter (ok and status <> 'CONFIRMED') as failed, count(*) filter (not ok) as errors
  from res join ({LOG}) on request_id::varchar = reservation_id""",
    "seats_per_section": f"""{ONE}, {RESULTS}, {TAKEN} select event_id, section, sum(n)::bigint as seats,
  (grouping(event_id) * 2 + grouping(section))::int as level
  from (select event_id, section, count(distinct seat_no) as n from taken group by all
    union all select distinct event_id, section, 0 from res) group by rollup (event_id, section)""",
    "latency_percentiles": f"""with m as (select 'processing_ms' as measure, post_ms + get_ms as v from ({LOG}) where ok
  union all select 'latency_ms', latency_ms from ({LOG}) where ok)
""" + " union all ".join(
        f"select measure, {p}::double as point, quantile_cont(v::double, {p}) as milliseconds from m group by measure"
        for p in (0.5, 0.95, 0.99)),
    "latency_percentiles_approx": f"""select measure, point, count(*) as n, true as within_bound
  from (select unnest(['processing_ms', 'latency_ms']) as measure from ({TIMED}) where ok),
    (select unnest([0.5, 0.95, 0.99])::double as point) group by all""",
    "check_report": """select *, pass_rate > 0.99 as checks_ok from (
select count(*) as requests, sum(1 + taken + answered)::bigint as checks, sum(taken + answered + resolved)::bigint as passed, sum(answered)::bigint as completed,
  sum(taken + answered + resolved) / sum(1 + taken + answered) as pass_rate, sum(taken) / count(*) as post_rate, sum(answered) / sum(taken) as get_rate,
  sum(resolved) / sum(answered) as resolved_rate
from (select (not (event_type = 'error' and event_id % 2 = 0))::int as taken, (event_type <> 'error')::int as answered,
  (event_type <> 'error' and event_id % 50 <> 0)::int as resolved from events))""",
    "request_alerts": alerts("true"),
    "stream_alerts": alerts("window_end <= (select max(ts) from events) - interval 10 minute"),
    "user_dedup": f"""with recursive q as (select *, row_number() over (partition by user_id order by ts, reservation_id) as rn from ({CMD})),
f as (
  select *, ts as last_ts, true as accepted, reservation_id as answered_by from q where rn = 1
  union all
  select q.*, case when q.ts >= f.last_ts + interval 1 hour then q.ts else f.last_ts end, q.ts >= f.last_ts + interval 1 hour,
    case when q.ts >= f.last_ts + interval 1 hour then q.reservation_id else f.answered_by end
  from f join q on q.user_id = f.user_id and q.rn = f.rn + 1)
select * exclude (rn, last_ts) from f""",
    "reservation_history": f"""{ONE}, {RESULTS} select * exclude (epoch), completed_ts::date < date '2024-01-11' as archived from res""",
    "slo_report": slo(5000, 0.99),
    "slo_report_large": slo(10000, 0.95),
    "duplicate_seats": f"""{ONE}, {RESULTS}, {TAKEN} select event_id, section, 1::bigint as epoch, seat_no, count(*) as times
  from taken group by all having count(*) > 1""",
    "duplicate_seats_planted": f"""{ONE}, {RESULTS} select event_id, section, epoch,
  unnest(range(first_seat, first_seat + seat_count))::int as seat_no, 2::bigint as times
  from (select * from res where first_seat is not null order by reservation_id::bigint limit 1)""",
    "allocation_violations": f"{ONE}, {RESULTS} " + violations(f"select *, {SEAT_LIST} as seats from res"),
    "allocation_violations_planted": f"{ONE}, {RESULTS} " + violations(f"""select reservation_id, section, seat_count,
    case when n % 20 = 15 then 'LOST' else status end as status,
    case when n % 5 = 0 and len(seats) = 0 then [section || '-1']
      when n % 20 = 0 then seats[2:] when n % 20 = 5 then list_transform(seats, lambda s: 'B-' || s)
      when n % 20 = 10 and len(seats) > 1 then list_reverse(seats) else seats end as seats
    from (select *, reservation_id::bigint as n, {SEAT_LIST} as seats from res)"""),
    "inventory_balance": f"""{ALL} select event_id, section, total, available, reserved, kept_available,
  available + reserved = total and available = kept_available as balanced
  from (select event_id, section, count(*) as total, count(*) filter (status = 'AVAILABLE') as available,
    count(*) filter (status = 'RESERVED') as reserved from fin group by event_id, section)
  join (select event_id, section, arg_max(len(fr), rn)::bigint as kept_available from st group by event_id, section)
    using (event_id, section)""",
    "inventory_balance_reinit": "with recursive " + fold("st1", f"select * from ({CMD}) where event_id % 2 <> 0", "event_id % 2 <> 0")
    + ", " + fold("st2", f"select * from ({CMD}) where {_OVER}", "event_id % 2 = 0", 12) + """,
    both_ as (select *, 24 as total, 21 as free from st1 union all select *, 12, 11 from st2),
    each as (select event_id, section, total::bigint as total, arg_max(len(fr), rn)::bigint as kept_available,
      free - coalesce(sum(seat_count) filter (f is not null and event_id % 9 <> 0), 0)::bigint as available
      from both_ group by event_id, section, total, free)
    select event_id, section, total, available, total - available as reserved, kept_available,
      available = kept_available as balanced from each""",
    "unresolved_commands": f"""{ONE}, {RESULTS} select c.reservation_id, count(*)::bigint as asked, 0::bigint as answered
  from ({CMD}) c left join res r on r.reservation_id = c.reservation_id
  where r.status is null group by c.reservation_id""",
    "unresolved_commands_planted": f"""select reservation_id, 1::bigint as asked, answered from (
  select reservation_id, (case when n % 7 = 0 or n % 13 = 0 then 0 when n % 11 = 0 then 2 else 1 end)::bigint as answered
  from (select reservation_id, reservation_id::bigint as n from ({CMD}))) where answered <> 1""",
}

# A stream ends where its batch twin does.
for _stream, _twin in {
    "stream_seat_allocation": "seat_allocation",
    "stream_seat_allocation_stateful": "seat_allocation",
    "stream_prefilter": "reservation_routing",
    "stream_user_dedup": "user_dedup",
    "ingest_tickets_twice": "ingest_tickets",
    "stream_reservation_table": "reservation_table",
    "stream_events_with_changes": "events_with_changes",
}.items():
    ORACLE[_stream] = ORACLE[_twin]
