"""Independent DuckDB SQL for each registered query (the correctness oracle).

The SQL is written from the operator semantics, not generated from the Spark plans.
Shared common table expressions rebuild the canonical views and the validation chain.
"""

from __future__ import annotations

import re

from ..schema import NOTIF_EVENTS, REC_EVENTS, USER_EVENTS


def _in(xs):
    return "(" + ", ".join(f"'{x}'" for x in xs) + ")"


SHOP_EVENTS = """
select id,
  case when event_type in ('recommendation_shown','recommendation_clicked','recommendation_accepted','recommendation_rejected') then 'recommendation-actions'
       when event_type in ('discount_offer_sent','reminder_sent','offer_accepted','offer_declined') then 'notification-events'
       else 'user-events' end as topic,
  case when anon then 'v' || cast(uid as string) else 'u' || cast(uid as string) end
    || '-' || cast(cast(event_time as date) as string) || '-s0' as session_id,
  case when anon then 'visitor_' || cast(uid as string) else '' end as visitor_id,
  case when anon then cast(null as string) else cast(uid as string) end as user_id,
  event_time, event_type, product_id,
  case when event_type = 'refund_request' and id % 3 <> 0 then 'ORD-' || cast(id as string) end as order_id_for_refund,
  id % 7 = 0 as is_recommended,
  case when id % 7 = 0 then (['home', 'product_detail', 'final_cart', 'notification'])[id % 4 + 1] else '' end as recommendation_view
from (
  select event_id as id, user_id as uid, user_id % 5 = 0 as anon, ts as event_time,
    regexp_extract(props, '([0-9]+)', 1) as product_id,
    case event_type when 'view' then 'view' when 'click' then 'add_to_cart' when 'purchase' then 'transaction'
      when 'signup' then case when event_id % 2 = 0 then 'quantity' else 'delete_from_cart' end
      else case event_id % 9 when 0 then 'recommendation_shown' when 1 then 'recommendation_clicked'
        when 2 then 'recommendation_accepted' when 3 then 'recommendation_rejected'
        when 4 then 'discount_offer_sent' when 5 then 'reminder_sent'
        when 6 then 'offer_accepted' when 7 then 'offer_declined' else 'refund_request' end end as event_type
  from events) x
"""

SHOP_PRODUCTS = """
select p_partkey as id, p_name as title, p_type as category, p_retailprice as price, p_size as reviews,
  cast(p_partkey % 50 as double) / 10 as stars, p_brand = 'Brand#1' as is_best_seller
from part
"""

SHOP_USERS = """
select c_custkey as id, c_name as first_name, lower(replace(c_name, '#', '')) || '@example.com' as email,
  n_name as country, r_name as region, c_custkey % 20 = 0 as is_deleted
from customer join nation on c_nationkey = n_nationkey join region on n_regionkey = r_regionkey
"""

# copies of an id: every column decides, NULLs first
COPIES = ", ".join(f"{c} nulls first" for c in (
    "event_time", "event_type", "product_id", "user_id", "visitor_id", "session_id", "order_id_for_refund",
    "is_recommended", "recommendation_view"))

BASE = f"""
with se as ({SHOP_EVENTS}),
sp as ({SHOP_PRODUCTS}),
su as ({SHOP_USERS}),
norm as (
  select id, topic, session_id, visitor_id,
    case when trim(user_id) = '' then null else user_id end as user_id,
    event_time, event_type, product_id,
    case when trim(order_id_for_refund) = '' then null else order_id_for_refund end as order_id_for_refund,
    is_recommended, recommendation_view
  from se),
keyed as (
  select *, cast(event_time as date) as event_date,
    case when user_id is not null and trim(user_id) <> '' then user_id else visitor_id end as customer_key,
    case when user_id is not null and trim(user_id) <> '' then 'user' else 'visitor' end as id_type
  from norm
  where (case when user_id is not null and trim(user_id) <> '' then user_id else visitor_id end) is not null
    and trim(case when user_id is not null and trim(user_id) <> '' then user_id else visitor_id end) <> ''),
common as (
  select * from keyed
  where event_time is not null and id is not null and visitor_id is not null and event_type is not null
  qualify row_number() over (partition by topic, id order by {COPIES}) = 1),
ue as (
  select * from common where topic = 'user-events' and event_type in {_in(USER_EVENTS)}
    and product_id is not null and coalesce(try_cast(product_id as bigint) > 0, false)
    and not (event_type = 'refund_request' and order_id_for_refund is null)),
rec as (
  select * from common where topic = 'recommendation-actions' and event_type in {_in(REC_EVENTS)}
    and product_id is not null and coalesce(try_cast(product_id as bigint) > 0, false)),
notif as (
  select * from common where topic = 'notification-events' and event_type in {_in(NOTIF_EVENTS)}),
allv as (select * from ue union all by name select * from rec union all by name select * from notif)
"""


UNCLEAN = """
select * from se0
union all by name select * replace (product_id || '7' as product_id) from se0 where id % 50 = 0
union all by name select * replace ('notification-events' as topic) from se0 where id % 50 = 1
union all by name select * replace (id + 2000000000 as id, 'recommendation-actions' as topic, 'view' as event_type) from se0 where id % 50 = 2
union all by name select * replace (id + 3000000000 as id, 'teleport' as event_type) from se0 where id % 50 = 3
union all by name select * replace (null::bigint as id) from se0 where id % 50 = 4
union all by name select * replace (id + 5000000000 as id, null::timestamp as event_time) from se0 where id % 50 = 5
union all by name select * replace (id + 6000000000 as id, null::varchar as visitor_id, '77' as user_id) from se0 where id % 50 = 6
union all by name select * replace (id + 7000000000 as id, null::varchar as event_type) from se0 where id % 50 = 7
union all by name select * replace (id + 8000000000 as id, 'user-events' as topic, 'view' as event_type, '' as product_id) from se0 where id % 50 = 8
union all by name select * replace (id + 9000000000 as id, 'user-events' as topic, 'view' as event_type, '-1' as product_id) from se0 where id % 50 = 9
"""


def unclean(sql: str) -> str:
    """The same query over events with every fault."""
    return sql.replace(f"with se as ({SHOP_EVENTS})", f"with se0 as ({SHOP_EVENTS}),\nse as ({UNCLEAN})")


def q(body: str, extra: str = "") -> str:
    """BASE CTEs, optional extra CTEs (text starting with a comma), then the final select."""
    return BASE + extra + "\n" + body


ORACLE: dict[str, str] = {}


_ROUND6 = re.compile(r"round\(((?:[^()]|\((?:[^()]|\([^()]*\))*\))*?), 6\)")


def register(name: str, sql: str) -> None:
    # DuckDB's round() can return -0.0 where Spark returns 0.0; adding 0.0 normalises it
    ORACLE[name] = _ROUND6.sub(lambda m: f"(round({m.group(1)}, 6) + 0.0)", sql.strip())


# --- daily analytics ---------------------------------------------------------------
register("total_registered_customers", q(
    "select cast(count(distinct user_id) as bigint) as total_registered_customers from ue where user_id is not null"))
register("total_anonymous_visitors", q(
    "select cast(count(distinct visitor_id) as bigint) as total_anonymous_visitors from ue where user_id is null"))
register("total_customers", q(
    "select cast(count(*) as bigint) as total_customers from ("
    "select user_id as c from ue where user_id is not null union "
    "select visitor_id as c from ue where user_id is null) t where c is not null"))
register("total_events", q("select cast(count(*) as bigint) as total_events from ue"))
for _k, _t in [("total_views", "view"), ("total_add_to_cart", "add_to_cart"),
               ("total_purchases", "transaction"), ("total_refunds", "refund_request")]:
    register(_k, q(f"select cast(count(*) filter (where event_type = '{_t}') as bigint) as {_k} from ue"))
register("events_by_type", q(
    "select event_type, cast(count(*) as bigint) as event_count from ue group by event_type"))
register("recommendations_generated", q(
    "select cast(count(*) as bigint) as recommendations_generated from rec"))
register("recommendation_event_counts", q(
    "select event_type, cast(count(*) as bigint) as event_count from rec group by event_type"))
register("notifications_generated", q(
    "select cast(count(*) as bigint) as notifications_generated from notif"))
register("notification_counts", q(
    "select event_type, cast(count(*) as bigint) as event_count from notif group by event_type"))
register("daily_summary", q("""
select (select max(event_date) from ue) as run_date,
  (select cast(count(distinct user_id) as bigint) from ue where user_id is not null) as total_registered_customers,
  (select cast(count(distinct visitor_id) as bigint) from ue where user_id is null) as total_anonymous_visitors,
  (select cast(count(distinct coalesce(user_id, visitor_id)) as bigint) from ue) as total_customers,
  (select cast(count(*) as bigint) from ue) as total_events,
  (select cast(count(*) filter (where event_type = 'view') as bigint) from ue) as total_views,
  (select cast(count(*) filter (where event_type = 'add_to_cart') as bigint) from ue) as total_add_to_cart,
  (select cast(count(*) filter (where event_type = 'transaction') as bigint) from ue) as total_purchases,
  (select cast(count(*) filter (where event_type = 'refund_request') as bigint) from ue) as total_refunds,
  (select cast(count(*) as bigint) from rec) as recommendations_generated,
  (select cast(count(*) as bigint) from notif) as notifications_generated
"""))


def _top(key, out, where):
    return q(f"select {key}, cast(count(*) as bigint) as {out} from ue where {where} "
             f"group by {key} order by {out} desc, {key} asc nulls last limit 10")


register("top_viewed_products", _top("product_id", "view_count", "event_type = 'view'"))
register("top_cart_products", _top("product_id", "add_to_cart_count", "event_type = 'add_to_cart'"))
register("top_purchased_products", _top("product_id", "purchase_count", "event_type = 'transaction'"))
register("most_active_users", _top("user_id", "event_count", "user_id is not null"))
register("most_active_visitors", _top("visitor_id", "event_count", "user_id is null"))

register("daily_summary_incremental", ORACLE["daily_summary"])
register("most_active_incremental", ORACLE["most_active_users"])

# --- ingest ------------------------------------------------------------------------------
KEYED_COLS = ("id, topic, session_id, visitor_id, user_id, event_time, event_type, product_id, "
              "order_id_for_refund, is_recommended, recommendation_view, event_date, customer_key, id_type")

register("kafka_rows", q("""
select topic,
  '{"id":' || cast(id as varchar) || ',"topic":"' || topic || '"'
  || case when session_id is not null then ',"session_id":"' || session_id || '"' else '' end
  || case when visitor_id is not null then ',"visitor_id":"' || visitor_id || '"' else '' end
  || case when user_id is not null then ',"user_id":"' || user_id || '"' else '' end
  || ',"timestamp":"' || strftime(event_time, '%Y-%m-%dT%H:%M:%S.%f') || '"'
  || ',"event_type":"' || event_type || '"'
  || case when product_id is not null then ',"product_id":"' || product_id || '"' else '' end
  || case when order_id_for_refund is not null then ',"order_id_for_refund":"' || order_id_for_refund || '"' else '' end
  || ',"is_recommended":' || case when is_recommended then 'true' else 'false' end
  || ',"recommendation_view":"' || recommendation_view || '"}' as value
from se"""))
register("decode_events", q(f"select {KEYED_COLS} from keyed"))
register("event_time_date", q("select id, event_time, cast(event_time as date) as event_date from se"))
register("customer_key", q("""
select id,
  case when user_id is not null and trim(user_id) <> '' then user_id else visitor_id end as customer_key,
  case when user_id is not null and trim(user_id) <> '' then 'user' else 'visitor' end as id_type
from se"""))
register("drop_unkeyed", unclean(q(f"select {KEYED_COLS} from keyed")))
register("topic_split", q("select *, topic as part from keyed"))
register("validate_common", unclean(q(
    f"select {KEYED_COLS} from common where event_type in "
    + _in(USER_EVENTS + REC_EVENTS + NOTIF_EVENTS))))
register("unclean_validated", unclean(q(f"select {KEYED_COLS} from allv")))
register("malformed_messages", unclean(q(f"select {KEYED_COLS} from allv")))
register("unclean_stream", unclean(q(f"select {KEYED_COLS} from allv")))
register("validate_user_events", q(f"select {KEYED_COLS} from ue"))
register("validate_recommendation_events", q(f"select {KEYED_COLS} from rec"))
register("validate_notification_events", q(f"select {KEYED_COLS} from notif"))
register("union_validated", q(f"select {KEYED_COLS} from allv"))
REJECT_REASONS = f"""
select topic, reason, count(*) as rejected from (
  select topic,
    case when event_time is null then 'null_event_time'
         when id is null then 'null_id'
         when visitor_id is null then 'null_visitor_id'
         when event_type is null then 'null_event_type'
         when dup then 'duplicate_id'
         when event_type not in {_in(USER_EVENTS + REC_EVENTS + NOTIF_EVENTS)} then 'unknown_event_type'
         when not (case topic when 'user-events' then event_type in {_in(USER_EVENTS)}
                              when 'recommendation-actions' then event_type in {_in(REC_EVENTS)}
                              when 'notification-events' then event_type in {_in(NOTIF_EVENTS)}
                              else false end) then 'type_not_on_topic'
         when topic in ('user-events', 'recommendation-actions') and (product_id is null or trim(product_id) = '')
              then 'missing_product'
         when topic in ('user-events', 'recommendation-actions')
              and not coalesce(try_cast(product_id as bigint) > 0, false) then 'bad_product_id'
         when topic = 'user-events' and event_type = 'refund_request' and order_id_for_refund is null
              then 'refund_without_order'
    end as reason
  from (select *, case when ok then row_number() over (partition by ok, topic, id
                        order by {COPIES}) > 1 else false end as dup
        from (select *, event_time is not null and id is not null and visitor_id is not null
                        and event_type is not null as ok from keyed) a) b
) c where reason is not null group by topic, reason"""
register("reject_reasons", unclean(q(REJECT_REASONS)))
register("reject_stream", unclean(q(f"""
select topic, reason, cast(sum(n) as bigint) as messages from (
  select topic, reason, rejected as n from ({REJECT_REASONS}) r
  union all select topic, 'accepted', count(*) from allv group by topic
  union all select topic, 'no_customer_key', count(*) from se
    where coalesce(trim(user_id), '') = '' and coalesce(trim(visitor_id), '') = '' group by topic
  union all select topic, 'malformed', count(*) from se0 where id % 10 = 3 group by topic) x
group by topic, reason""")))
register("topic_type_match", unclean(q(f"""
select {KEYED_COLS} from keyed
where (case when event_type in {_in(USER_EVENTS)} then 'user-events'
            when event_type in {_in(REC_EVENTS)} then 'recommendation-actions'
            when event_type in {_in(NOTIF_EVENTS)} then 'notification-events' end) = topic""")))
register("enrich_with_products", q("""
select a.id, a.topic, a.product_id, p.category as product_category, cast(p.price as double) as product_price
from allv a left join sp p on a.product_id = cast(p.id as varchar)"""))

# --- sources and sinks -------------------------------------------------------------------
register("products_csv_scan", q(
    "select cast(id as varchar) as product_id, category as product_category, price as product_price from sp"))
register("parquet_scan", q(f"select {KEYED_COLS} from ue"))
register("raw_events_sink", q(f"select {KEYED_COLS} from allv"))
register("scan_or_empty", q(f"select {KEYED_COLS} from notif"))
register("seed_events_scan", q(
    "select id, nullif(user_id, '') as user_id, nullif(visitor_id, '') as visitor_id, event_time, event_type, "
    "nullif(product_id, '') as product_id, is_recommended, order_id_for_refund from se"))
register("events_csv_scan", q(
    "select user_id, nullif(visitor_id, '') as visitor_id, session_id, event_time, event_type, "
    "product_id, is_recommended, order_id_for_refund from ue"))
register("flat_event_export", q(
    "select user_id, nullif(visitor_id, '') as visitor_id, session_id, strftime(event_time, '%Y-%m-%dT%H:%M:%S.%f') as timestamp, event_type, "
    "product_id, is_recommended::varchar as is_recommended, order_id_for_refund from ue"))
register("bucketed_compaction", q(f"select {KEYED_COLS} from allv"))
register("incremental_compaction", q(f"select {KEYED_COLS} from allv"))
DUMPS = q(f"""
select {KEYED_COLS}, 'user_events' as dump from ue
union all select {KEYED_COLS}, 'recommendation_events' from rec
union all select {KEYED_COLS}, 'notification_events' from notif""")
register("topic_dump_sink", DUMPS)
register("seed_csv_load", q("select id, email, country from su where not is_deleted"))
register("active_users_only", q("select id, email from su where not is_deleted"))

# --- sessions and customer value ----------------------------------------------------------
SESSION_CTES = """,
sev as (
  select *, coalesce(case when user_id is not null and trim(user_id) <> '' then user_id end,
                     nullif(regexp_extract(session_id, '^u([0-9]+)-', 1), ''), 'nan') as suser,
         regexp_replace(coalesce(cast(product_id as varchar), ''), '\\.0$', '') as pid
  from ue),
sfirst as (
  select session_id, suser, pid, min(event_time) as ft, min(id) filter (where true) as dummy,
         arg_min(id, (event_time, id)) as fid
  from sev where event_type in ('add_to_cart', 'transaction') and pid <> '' and pid <> 'nan'
  group by session_id, suser, pid),
sbask as (
  select session_id, suser, string_agg(pid, ',' order by ft, fid) as cart_products, count(*) as n_items
  from sfirst group by session_id, suser),
sstat as (
  select session_id, suser, bool_or(event_type = 'transaction') as has_transaction,
         count(*) as total_session_events, min(event_time) as first_timestamp, max(event_time) as last_timestamp
  from sev group by session_id, suser)
"""
register("session_basket", q("""
select s.suser as user_id, s.session_id,
  case when has_transaction then 'transaction' when coalesce(n_items, 0) > 0 then 'add_to_cart' else 'view' end as event_type,
  has_transaction, coalesce(b.cart_products, '') as cart_products, cast(coalesce(n_items, 0) as bigint) as total_cart_items,
  total_session_events, first_timestamp, last_timestamp
from sstat s left join sbask b on s.session_id = b.session_id and s.suser = b.suser""", SESSION_CTES))
register("logged_in_only", q(
    "select user_id, count(*) as events from allv where user_id is not null and trim(user_id) <> '' group by user_id"))
register("derive_session_id", q(
    "select id, user_id || '_' || cast(cast(event_time as date) as varchar) as session_id from ue "
    "where user_id is not null and trim(user_id) <> ''"))
register("recover_user_from_session", q(
    "select coalesce(nullif(regexp_extract(session_id, '^u([0-9]+)-', 1), ''), 'nan') as user_id, "
    "count(*) as events from ue group by 1"))
register("normalise_product_id", q(
    "select id, regexp_replace(cast(cast(product_id as double) as varchar), '\\.0$', '') as product_id from ue"))
register("parse_basket", q(
    "select b.session_id, b.suser as user_id, b.cart_products as items from sbask b", SESSION_CTES))

VALUE_CTES = """,
li as (select * from allv where user_id is not null and trim(user_id) <> ''),
snap as (select max(event_time) as snapshot from li),
uagg as (
  select user_id, count(*) as total_events,
    count(*) filter (where event_type = 'view') as view_count,
    count(*) filter (where event_type = 'add_to_cart') as add_count,
    count(*) filter (where event_type = 'delete_from_cart') as remove_count,
    count(*) filter (where event_type = 'transaction') as transaction_count,
    count(*) filter (where event_type = 'refund_request') as refund_count,
    count(*) filter (where event_type = 'recommendation_shown') as rec_shown,
    count(*) filter (where event_type = 'recommendation_clicked') as rec_clicked,
    min(event_time) as first_event_time, max(event_time) as last_event_time,
    count(distinct session_id) as unique_sessions, count(distinct product_id) as unique_products,
    max(case when event_type = 'transaction' then event_time end) as last_tx
  from li group by user_id),
usess as (
  select user_id, session_id, bool_or(event_type = 'add_to_cart') as had_add,
         bool_or(event_type = 'transaction') as had_tx
  from li where event_type in ('add_to_cart', 'transaction') group by user_id, session_id),
uab as (select user_id, count(*) as abandoned_cart_sessions from usess where had_add and not had_tx group by user_id),
feat as (
  select u.user_id, transaction_count, add_count, remove_count, view_count, refund_count,
    unique_sessions, unique_products,
    case when add_count > 0 then transaction_count / add_count else 0.0 end as conversion_rate,
    case when add_count > 0 then remove_count / add_count else 0.0 end as removal_rate,
    case when unique_sessions > 0 then coalesce(abandoned_cart_sessions, 0) / unique_sessions else 0.0 end as cart_abandon_rate,
    case when rec_shown > 0 then rec_clicked / rec_shown else 0.0 end as recommendation_ctr,
    cast(least(coalesce(floor((epoch_us(snapshot) - epoch_us(last_tx)) / 86400000000.0), 999), 999) as bigint) as days_since_last_tx,
    total_events / (floor((epoch_us(last_event_time) - epoch_us(first_event_time)) / 86400000000.0) + 1) as events_per_day,
    cast(floor((epoch_us(last_event_time) - epoch_us(first_event_time)) / 86400000000.0) + 1 as bigint) as active_days,
    coalesce(abandoned_cart_sessions, 0) as abandoned_cart_sessions, total_events
  from uagg u cross join snap left join uab a on u.user_id = a.user_id),
scored as (
  select *, round(transaction_count * 3.0 + conversion_rate * 2.0 + recommendation_ctr * 0.5
    + removal_rate * -1.5 + cart_abandon_rate * -1.0 + (refund_count / (transaction_count + 1)) * -2.0
    + ln(1 + cast(days_since_last_tx as double)) * -0.3, 9) as value_score
  from feat),
pct as (
  select *, (rank() over (order by value_score) - 1 + (count(*) over (partition by value_score) + 1) / 2.0)
            / count(*) over () as pct_rank
  from scored),
labeled as (
  select *, case when pct_rank <= 0.33 then 0 when pct_rank <= 0.66 then 1 else 2 end as value_label from pct)
"""
register("customer_counts", q("""
select u.user_id, total_events, view_count, add_count, remove_count, transaction_count, refund_count,
  rec_shown, rec_clicked, first_event_time, last_event_time, unique_sessions, unique_products,
  cast(coalesce(a.abandoned_cart_sessions, 0) as bigint) as abandoned_cart_sessions
from uagg u left join uab a on u.user_id = a.user_id""", VALUE_CTES))
register("abandoned_cart_sessions", q("select user_id, abandoned_cart_sessions from uab", VALUE_CTES))
register("feature_left_merge", q(
    "select user_id, cast(abandoned_cart_sessions as bigint) as abandoned_cart_sessions from feat", VALUE_CTES))
register("last_tx_align", q("select user_id, days_since_last_tx from feat", VALUE_CTES))
register("customer_value_features", q("""
select user_id, transaction_count, add_count, remove_count, view_count, refund_count, unique_sessions,
  unique_products, round(conversion_rate, 6) as conversion_rate, round(removal_rate, 6) as removal_rate,
  round(cart_abandon_rate, 6) as cart_abandon_rate, round(recommendation_ctr, 6) as recommendation_ctr,
  days_since_last_tx, round(events_per_day, 6) as events_per_day, active_days
from feat""", VALUE_CTES))
register("customer_value_features_incremental", ORACLE["customer_value_features"])
register("customer_value_score", q("select user_id, round(value_score, 6) as value_score from scored", VALUE_CTES))
register("customer_value_label", q(
    "select user_id, round(value_score, 6) as value_score, cast(value_label as integer) as value_label from labeled",
    VALUE_CTES))
register("pct_rank_average", q("select user_id, round(pct_rank, 6) as pct_rank from pct", VALUE_CTES))
register("value_label_summary", q("""
select cast(value_label as integer) as value_label, count(*) as customers,
  round(min(value_score), 6) as min_score, round(max(value_score), 6) as max_score
from labeled group by value_label""", VALUE_CTES))

# --- itemsets, rules, predictions ---------------------------------------------------------
BRAND_CTES = """,
bb as (
  select l_orderkey as basket_id, list_sort(list(distinct p_brand)) as items
  from lineitem join part on l_partkey = p_partkey group by l_orderkey)
"""


def _mining_ctes(src: str, min_support: float = 0.001) -> str:
    """Frequent itemsets by full subset enumeration of each basket (exact support counts),
    then rules by splitting each itemset with a bit mask."""
    return f""",
mb as (select basket_id, list_sort(list_distinct(items)) as items from {src} where len(items) > 0),
nb as (select count(*) as n from mb),
subsets as (
  select basket_id, list_filter(items, lambda x, i: ((m >> (i - 1)) & 1) = 1) as s
  from (select basket_id, items, unnest(range(1, cast(pow(2, len(items)) as bigint))) as m from mb) t),
fi as (
  select s as items, len(s) as size, count(*) as freq, count(*) / (select n from nb) as support
  from subsets group by s having count(*) >= ceil({min_support} * (select n from nb))),
fik as (select array_to_string(items, ',') as k, support from fi),
splits as (
  select list_filter(items, lambda x, i: ((m >> (i - 1)) & 1) = 1) as a,
         list_filter(items, lambda x, i: ((m >> (i - 1)) & 1) = 0) as c, support
  from (select items, support, unnest(range(1, cast(pow(2, size) as bigint) - 1)) as m from fi where size >= 2) t),
rl as (
  select sp.a as antecedents, sp.c as consequents, fa.support as antecedent_support,
    fc.support as consequent_support, sp.support, sp.support / fa.support as confidence
  from splits sp join fik fa on array_to_string(sp.a, ',') = fa.k
                 join fik fc on array_to_string(sp.c, ',') = fc.k
  where sp.support / fa.support >= 0.1),
rules as (
  select *, confidence / consequent_support as lift,
    support - antecedent_support * consequent_support as leverage,
    case when confidence < 1 then (1 - consequent_support) / (1 - confidence) end as conviction
  from rl)
"""


def _itemsets_sql(ctes):
    return q("select array_to_string(items, ',') as items, cast(size as bigint) as size, freq, "
             "round(support, 6) as support from fi", ctes)


def _rules_sql(ctes):
    return q("""
select array_to_string(antecedents, ',') as antecedents, array_to_string(consequents, ',') as consequents,
  round(antecedent_support, 6) as antecedent_support, round(consequent_support, 6) as consequent_support,
  round(support, 6) as support, round(confidence, 6) as confidence, round(lift, 6) as lift,
  round(leverage, 6) as leverage, round(conviction, 6) as conviction
from rules""", ctes)


BRAND_MINING = BRAND_CTES + _mining_ctes("bb")
SESSION_MINING = SESSION_CTES + """,
sbk as (select session_id || '|' || suser as basket_id, string_split(cart_products, ',') as items from sbask)
""" + _mining_ctes("sbk")

register("basket_split", q("""
select case when cast(('0x' || substr(md5('42:' || cast(basket_id as varchar)), 1, 8)) as bigint) % 100 < 30
            then 'test' else 'train' end as split, count(*) as baskets
from bb group by 1""", BRAND_CTES))
register("frequent_itemsets", _itemsets_sql(BRAND_MINING))
register("association_rules", _rules_sql(BRAND_MINING))
register("rules_sink", _rules_sql(BRAND_MINING))
register("session_itemsets", _itemsets_sql(SESSION_MINING))
register("session_rules", _rules_sql(SESSION_MINING))

PREDICT_CTES = """,
rk as (select *, row_number() over () as rule_id from rules),
bitems as (select basket_id, items, unnest(items) as item from mb),
matched as (
  select b.basket_id, b.items, r.rule_id, r.consequents, r.lift, r.confidence
  from bitems b join rk r on r.antecedents[1] = b.item
  where list_has_all(b.items, r.antecedents)),
cand as (
  select basket_id, item, lift, confidence from (
    select basket_id, items, lift, confidence, unnest(consequents) as item from matched) t
  where not list_contains(items, item)),
best as (
  select basket_id, item, lift, confidence from cand
  qualify row_number() over (partition by basket_id, item order by lift desc, confidence desc) = 1),
pred as (
  select basket_id, item, row_number() over (partition by basket_id order by lift desc, confidence desc, item) as rank
  from best qualify rank <= 5)
"""
register("basket_predictions", q(
    "select basket_id, string_agg(item, ',' order by rank) as predicted_items from pred group by basket_id",
    SESSION_MINING + PREDICT_CTES))
register("top_n_per_basket", q("select basket_id, item, cast(rank as bigint) as rank from pred",
                               SESSION_MINING + PREDICT_CTES))
register("rule_subset_join", q("select basket_id, count(*) as matched_rules from matched group by basket_id",
                               SESSION_MINING + PREDICT_CTES))
register("rule_summary", q("""
select (select count(*) from fi) as frequent_itemsets_count, count(*) as association_rules_count,
  round(avg(lift), 6) as avg_lift, round(avg(confidence), 6) as avg_confidence, round(avg(support), 6) as avg_support,
  (select count(*) from bbs where split = 'train') as train_transactions,
  (select count(*) from bbs where split = 'test') as test_transactions
from rules""", BRAND_CTES + """,
bbs as (select *, case when cast(('0x' || substr(md5('42:' || cast(basket_id as varchar)), 1, 8)) as bigint) % 100 < 30
                       then 'test' else 'train' end as split from bb),
bbt as (select * from bbs where split = 'train')
""" + _mining_ctes("bbt")))

TRAIN_MINING = BRAND_CTES + """,
bbs as (select *, case when cast(('0x' || substr(md5('42:' || cast(basket_id as varchar)), 1, 8)) as bigint) % 100 < 30
                       then 'test' else 'train' end as split from bb),
bbt as (select * from bbs where split = 'train'),
tb as (select basket_id, list_sort(list_distinct(items)) as items from bbs where split = 'test')
""" + _mining_ctes("bbt", 0.005)
register("train_split_rules", _rules_sql(TRAIN_MINING))
register("heldout_predictions", q("select basket_id, item, cast(rank as bigint) as rank from pred",
                                  TRAIN_MINING + PREDICT_CTES.replace("from mb)", "from tb)")))

# --- recommendations ----------------------------------------------------------------------
RECO_CTES = SESSION_MINING + """,
seeds as (
  select customer_key as actor, id_type, product_id,
    row_number() over (partition by customer_key, id_type order by event_time desc, id desc) as pos
  from ue where product_id is not null qualify pos <= 10),
actors as (select distinct actor, id_type from seeds),
sb as (select actor, id_type, actor || chr(1) || id_type as basket_id, list_sort(list(distinct product_id)) as items
       from seeds group by actor, id_type),
rk2 as (select *, row_number() over () as rule_id from rules),
sbi as (select basket_id, items, unnest(items) as item from sb),
m2 as (select b.basket_id, b.items, r.consequents, r.lift, r.confidence
       from sbi b join rk2 r on r.antecedents[1] = b.item where list_has_all(b.items, r.antecedents)),
c2 as (select basket_id, item, lift, confidence
       from (select basket_id, items, lift, confidence, unnest(consequents) as item from m2) t
       where not list_contains(items, item)),
b2 as (select * from c2 qualify row_number() over (partition by basket_id, item order by lift desc, confidence desc) = 1),
p2 as (select basket_id, item, row_number() over (partition by basket_id order by lift desc, confidence desc, item) as rnk
       from b2 qualify rnk <= 5),
st0 as (select sb.actor, sb.id_type, p2.item as product_id, 0 as stage, p2.rnk as pos
        from p2 join sb on p2.basket_id = sb.basket_id
        where p2.item in (select cast(id as varchar) from sp)),
scat as (select distinct s.actor, s.id_type, p.category from seeds s join sp p on s.product_id = cast(p.id as varchar)
         where p.category is not null),
st2 as (
  select c.actor, c.id_type, cast(p.id as varchar) as product_id, 2 as stage,
    row_number() over (partition by c.actor, c.id_type
                       order by p.reviews desc nulls first, p.stars desc nulls first, p.id) as pos
  from scat c join sp p on p.category = c.category
  where not exists (select 1 from seeds s where s.actor = c.actor and s.id_type = c.id_type
                    and s.product_id = cast(p.id as varchar))),
st3 as (
  select a.actor, a.id_type, cast(p.id as varchar) as product_id, 3 as stage,
    row_number() over (partition by a.actor, a.id_type
                       order by p.is_best_seller desc, p.reviews desc nulls first, p.stars desc nulls first, p.id) as pos
  from actors a cross join sp p
  where not exists (select 1 from seeds s where s.actor = a.actor and s.id_type = a.id_type
                    and s.product_id = cast(p.id as varchar))),
allst as (select * from st0 union all select * from st2 union all select * from st3),
firsts as (select * from allst qualify row_number() over (partition by actor, id_type, product_id order by stage, pos) = 1),
recs as (select actor, id_type, product_id, stage,
           row_number() over (partition by actor, id_type order by stage, pos) as rnk from firsts qualify rnk <= 8)
"""
REQUEST_CTES = RECO_CTES.replace("actors as (select distinct actor, id_type from seeds)", """allseeds as (select * from seeds),
req as (select distinct actor, id_type from allseeds where try_cast(regexp_extract(actor, '[0-9]+$') as bigint) % 20 < 2),
actors as (select * from req)""").replace("from seeds", "from rseeds").replace("allseeds as (select * from rseeds),", "allseeds as (select * from seeds),").replace(
    "actors as (select * from req)", """actors as (select * from req),
rseeds as (select s.* from allseeds s join req using (actor, id_type)),
rs as (select distinct actor, id_type, product_id from rseeds),
peers as (select distinct r.actor, r.id_type, e.customer_key as peer, e.id_type as peer_type from ue e join rs r on e.product_id = r.product_id),
co as (select p.actor, p.id_type, e.product_id, count(*) as co_count from peers p join ue e on e.customer_key = p.peer and e.id_type = p.peer_type
  where e.product_id is not null and not exists (select 1 from rs where rs.actor = p.actor and rs.id_type = p.id_type and rs.product_id = e.product_id)
  group by all),
co8 as (select *, row_number() over (partition by actor, id_type order by co_count desc, product_id) as pos from co qualify pos <= 8),
st1 as (select actor, id_type, product_id, 1 as stage, pos from co8 where product_id in (select cast(id as varchar) from sp))""").replace(
    "select * from st0 union all select * from st2", "select * from st0 union all select * from st1 union all select * from st2")
register("co_occurrence", q("select actor, id_type, product_id, co_count, pos from co8", REQUEST_CTES))
register("recommend_for_requests", q(
    "select actor, id_type, product_id, cast(stage as bigint) as stage, rnk as rank from recs", REQUEST_CTES))
register("recent_interactions", q("select actor, id_type, product_id, pos from seeds", RECO_CTES))
register("recommend_for_users", q(
    "select actor, id_type, product_id, cast(stage as bigint) as stage, rnk as rank from recs", RECO_CTES))
register("rule_stage_recommendations", q("select actor, id_type, product_id, pos from st0", RECO_CTES))
register("category_popularity", q("select actor, id_type, product_id, pos from st2 where pos <= 8", RECO_CTES))
register("global_popularity", q("select actor, id_type, product_id, pos from st3 where pos <= 8", RECO_CTES))
register("exclude_seen_anti", q("""
select actor, id_type, product_id, row_number() over (partition by actor, id_type order by pos) as pos
from st2 where not exists (select 1 from st0 where st0.actor = st2.actor and st0.id_type = st2.id_type
                           and st0.product_id = st2.product_id)
qualify pos <= 8""", RECO_CTES))
register("exclude_current_product", q("""
select c.actor, c.id_type, cast(p.id as varchar) as product_id,
  row_number() over (partition by c.actor, c.id_type order by p.reviews desc nulls first, p.stars desc nulls first, p.id) as pos
from (select s.actor, s.id_type, s.product_id, p0.category from seeds s join sp p0 on s.product_id = cast(p0.id as varchar)
      where s.pos = 1 and p0.category is not null) c
join sp p on p.category = c.category
where cast(p.id as varchar) <> c.product_id
qualify pos <= 8""", RECO_CTES))

# --- daily report, carts and offers, catalogue, champion, activity --------------------------
REPORT_CTES = """,
rpt as (
  select event_date as date,
    coalesce(sum(case when event_type = 'transaction' then p.price end), 0.0) as total_revenue,
    count(*) filter (where event_type = 'transaction') as total_orders,
    coalesce(sum(case when event_type = 'transaction' and is_recommended then p.price end), 0.0) as recommended_revenue,
    count(*) filter (where event_type = 'view' and is_recommended) as impressions,
    count(*) filter (where event_type = 'add_to_cart' and is_recommended) as clicks,
    count(*) filter (where event_type = 'transaction' and is_recommended) as conversions
  from ue left join sp p on ue.product_id = cast(p.id as varchar)
  group by event_date),
report as (
  select date, total_revenue, total_orders, recommended_revenue,
    case when impressions > 0 then clicks / impressions * 100 else 0.0 end as recommender_ctr,
    case when clicks > 0 then conversions / clicks * 100 else 0.0 end as recommender_conversion
  from rpt)
"""
_REPORT_SELECT = ("select date, round(total_revenue, 6) as total_revenue, round(recommended_revenue, 6) as "
                  "recommended_revenue, round(recommender_ctr, 6) as recommender_ctr, "
                  "round(recommender_conversion, 6) as recommender_conversion, total_orders from report")
register("daily_report", q(_REPORT_SELECT, REPORT_CTES))
register("recent_reports", q(_REPORT_SELECT + " order by date desc limit 30", REPORT_CTES))
register("insert_if_absent", q(_REPORT_SELECT, REPORT_CTES))
register("revenue_join", q(
    "select ue.id, ue.product_id, p.price from ue join sp p on ue.product_id = cast(p.id as varchar) "
    "where event_type = 'transaction'"))

CART_CTES = VALUE_CTES + """,
cu as (select user_id, id, event_time, event_type, product_id from ue
       where user_id is not null and trim(user_id) <> ''),
snapc as (select max(event_time) as snap from cu),
c1 as (
  select *,
    sum(case when event_type = 'transaction' then 1 else 0 end)
      over (partition by user_id order by event_time, id rows between unbounded preceding and current row) as epoch,
    sum(case when (event_type = 'add_to_cart' and product_id is not null and trim(product_id) <> '')
                  or event_type = 'transaction' then 1 else 0 end)
      over (partition by user_id order by event_time, id rows between unbounded preceding and current row) as episode,
    sum(case when event_type = 'transaction' then 1 else 0 end) over (partition by user_id) as last_epoch,
    lead(event_time) over (partition by user_id order by event_time, id) as next_t,
    event_type in ('add_to_cart', 'delete_from_cart') and product_id is not null and trim(product_id) <> '' as ad
  from cu),
c2 as (select *, case when ad then lag(event_type) over (partition by user_id, epoch, product_id, ad
                                                            order by event_time, id) end as prev from c1),
c3 as (
  select *, sum(case when ad and event_type = 'add_to_cart' and coalesce(prev, '') <> 'add_to_cart' then 1
                     when ad and event_type = 'delete_from_cart' and prev = 'add_to_cart' then -1 else 0 end)
              over (partition by user_id, epoch order by event_time, id
                    rows between unbounded preceding and current row) as cart_size
  from c2),
ab as (
  select user_id, cast(episode as bigint) as episode, event_time as last_activity,
    event_time + interval 15 minute as notify_at, cast(cart_size as bigint) as cart_size
  from c3 cross join snapc
  where cart_size > 0 and coalesce(next_t, snap) > event_time + interval 15 minute
  qualify row_number() over (partition by user_id, episode order by event_time, id) = 1),
cartl as (
  select user_id, product_id, event_type from c1
  where epoch = last_epoch and ad
  qualify row_number() over (partition by user_id, product_id order by event_time desc, id desc) = 1),
cart as (select user_id, product_id from cartl where event_type = 'add_to_cart'),
cartp as (select c.user_id, c.product_id, p.title, cast(p.price as double) as price, cast(1 as bigint) as quantity
          from cart c left join sp p on c.product_id = cast(p.id as varchar)),
offers as (
  select a.user_id, a.episode, a.notify_at, l.value_label,
    cast(case l.value_label when 2 then 3 when 1 then 8 when 0 then 15 else 5 end as bigint) as discount,
    case l.value_label when 2 then 'High' when 1 then 'Medium' when 0 then 'Low' else 'Unknown' end as tier,
    coalesce(u.email, 'user_' || a.user_id || '@unknown.com') as email,
    'SAVE' || cast(case l.value_label when 2 then 3 when 1 then 8 when 0 then 15 else 5 end as varchar) || '-'
      || (select string_agg(substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789',
                 cast(floor(h / pow(36, i)) % 36 + 1 as integer), 1), '' order by i)
          from (select cast(('0x' || substr(md5(a.user_id || ':' || cast(a.episode as varchar)), 1, 12)) as bigint) as h) hh,
               range(0, 6) r(i)) as coupon
  from ab a
  left join (select user_id, cast(value_label as integer) as value_label from labeled) l on a.user_id = l.user_id
  left join (select cast(id as varchar) as user_id, email from su where not is_deleted) u on a.user_id = u.user_id)
"""
register("abandoned_carts_batch", q("select * from ab", CART_CTES))
register("cart_contents", q("select user_id, product_id from cart", CART_CTES))
register("cart_product_join", q("select * from cartp", CART_CTES))
register("cart_totals", q(
    "select user_id, cast(sum(quantity) as bigint) as items, round(sum(coalesce(price, 0.0) * quantity), 2) as total "
    "from cartp group by user_id", CART_CTES))
register("score_lookup", q("select user_id, episode, value_label from offers", CART_CTES))
register("email_lookup", q("select distinct user_id, email from offers", CART_CTES))
register("discount_offers", q("select * from offers", CART_CTES))
register("notifier_counters", q("""
select (select count(*) from cu) as events_processed, (select count(*) from ab) as cart_abandonments,
  (select count(*) from ab) as notifications_sent, (select count(distinct user_id) from cart) as active_carts""",
                                CART_CTES))

register("product_search", q("""
select id, title, category, price, (select count(*) from sp where title ilike '%RED%') as total,
  cast(ceil((select count(*) from sp where title ilike '%RED%') / 20) as bigint) as pages
from sp where title ilike '%RED%' order by id limit 20 offset 20"""))
def _title_pages() -> str:
    hits = "select id, title, price, row_number() over (order by id) as k, count(*) over () as total from sp where title ilike '%{}%'"
    page = "select '{}' as page, id, title, price, total from ({}) x where k between {} and {}"
    pages = [page.format("first", hits.format("RED"), 1, 20), page.format("second", hits.format("RED"), 21, 40)]
    pages += [page.format(t, hits.format(t), 1, 100) for t in ("b", "Lu", "een l", "%ss%u%", "no such title")]
    return "\nunion all ".join(pages)


register("product_search_indexed", q(_title_pages()))
register("products_in_category", q("""
select id, title, category, price, (select count(*) from sp where category = (select category from sp order by id limit 1)) as total,
  cast(ceil((select count(*) from sp where category = (select category from sp order by id limit 1)) / 20) as bigint) as pages
from sp where category = (select category from sp order by id limit 1) order by id limit 20"""))
register("categories_sorted", q(
    "select cast(dense_rank() over (order by category) as bigint) as id, category as category_name "
    "from (select distinct category from sp where category is not null) c"))
register("product_category_join", q("""
select p.id, p.title, c.id as category_id, c.category_name from sp p left join
  (select cast(dense_rank() over (order by category) as bigint) as id, category as category_name
   from (select distinct category from sp where category is not null) x) c on p.category = c.category_name"""))

CHAMP_CTES = REPORT_CTES + """,
runs as (
  select model_name, cast(date as varchar) as run_id, date as run_time, metric from (
    select date, 'total_revenue' as model_name, total_revenue as metric from report
    union all select date, 'recommender_ctr', recommender_ctr from report
    union all select date, 'recommender_conversion', recommender_conversion from report) u),
hist as (
  select *, metric is not null and (best is null or metric > best) as promoted from (
    select *, max(metric) over (partition by model_name order by run_time, run_id
                                rows between unbounded preceding and 1 preceding) as best from runs) t),
hist2 as (
  select *, last(case when promoted then run_id end ignore nulls) over (
    partition by model_name order by run_time, run_id rows between unbounded preceding and current row) as champion_run
  from hist)
"""
register("champion_history", q(
    "select model_name, run_id, round(metric, 6) as metric, promoted, champion_run from hist2", CHAMP_CTES))
register("champion_selection", q(
    "select model_name, arg_max(run_id, run_time) as champion_run from hist2 where promoted group by model_name",
    CHAMP_CTES))
register("customer_activity_batch", q("""
select time_bucket(interval 10 minute, event_time) as window_start,
  time_bucket(interval 10 minute, event_time) + interval 10 minute as window_end,
  customer_key, id_type, count(*) as event_count,
  count(*) filter (where event_type = 'view') as views,
  count(*) filter (where event_type = 'add_to_cart') as add_to_carts,
  count(*) filter (where event_type = 'delete_from_cart') as cart_removals,
  count(*) filter (where event_type = 'transaction') as transactions,
  count(*) filter (where event_type = 'refund_request') as refund_requests,
  count(*) filter (where event_type = 'recommendation_clicked') as recs_clicked,
  count(*) filter (where is_recommended) as recommended_events,
  count(distinct product_id) as distinct_products_touched
from allv group by 1, 2, customer_key, id_type"""))

# --- streaming --------------------------------------------------------------------------------
LAST_WATERMARK = "((select date_trunc('milliseconds', max(event_time)) from keyed) - interval 3 day)"
LIVE_CTES = CART_CTES.replace(
    "where user_id is not null and trim(user_id) <> ''),\nsnapc as (select max(event_time) as snap from cu)",
    f"where user_id is not null and trim(user_id) <> '' and event_time <= {LAST_WATERMARK}),\n"
    f"snapc as (select {LAST_WATERMARK} as snap)")
register("abandoned_carts_stream", q("select * from ab", LIVE_CTES))
register("discount_offers_stream", q("select * from offers", LIVE_CTES))
register("notifier_gauges_stream", q("""
select (select count(*) from ue where user_id is not null and trim(user_id) <> '') as events_processed,
  (select count(*) from ab) as cart_abandonments, (select count(*) from ab) as notifications_sent,
  (select count(distinct user_id) from cart) as active_carts""", LIVE_CTES))
register("stream_dedupe", q(f"select {KEYED_COLS} from allv"))
register("topic_dump_stream", DUMPS)
register("enriched_stream", ORACLE["enrich_with_products"])
register("customer_activity_stream", q("""
select * from (
select time_bucket(interval 10 minute, event_time) as window_start,
  time_bucket(interval 10 minute, event_time) + interval 10 minute as window_end,
  customer_key, id_type, count(*) as event_count,
  count(*) filter (where event_type = 'view') as views,
  count(*) filter (where event_type = 'add_to_cart') as add_to_carts,
  count(*) filter (where event_type = 'delete_from_cart') as cart_removals,
  count(*) filter (where event_type = 'transaction') as transactions,
  count(*) filter (where event_type = 'refund_request') as refund_requests,
  count(*) filter (where event_type = 'recommendation_clicked') as recs_clicked,
  count(*) filter (where is_recommended) as recommended_events,
  count(distinct product_id) as distinct_products_touched
from allv group by 1, 2, customer_key, id_type) w
where window_end <= (select max(event_time) from allv) - interval 10 minute"""))

_TOPIC_CTE = {"user-events": "ue", "recommendation-actions": "rec", "notification-events": "notif"}


def _metric_sql(m) -> str:
    src = _TOPIC_CTE[m.topic]
    where = f" where event_type = '{m.event_type}'" if m.event_type else ""
    if m.group == "total":
        return q(f"select count(*) as {m.column} from {src}{where}")
    if m.group == "minute":
        return q(f"select time_bucket(interval 1 minute, event_time) as window_start, "
                 f"time_bucket(interval 1 minute, event_time) + interval 1 minute as window_end, "
                 f"count(*) as {m.column} from {src}{where} group by 1, 2")
    return q(f"select {m.group}, count(*) as {m.column} from {src}{where} group by {m.group}")


def _register_metrics():
    from ..streaming.metrics import METRICS
    for m in METRICS:
        register(m.name, _metric_sql(m))


_register_metrics()
register("kafka_source", q(f"select {KEYED_COLS} from keyed"))
register("metric_csv_sink", _metric_sql(__import__("clickcast.streaming.metrics", fromlist=["BY_NAME"]).BY_NAME["views_per_minute"]))
register("feature_csv_sink", q("""
select s.suser as user_id, s.session_id, coalesce(b.cart_products, '') as cart_products
from sstat s left join sbask b on s.session_id = b.session_id and s.suser = b.suser""", SESSION_CTES))


def _report_rows() -> str:
    def row(name, columns, source):
        text = " || ';' || ".join(f"'{c}=' || coalesce(({c})::varchar, 'null')" for c in sorted(columns))
        return f"select '{name}' as report, {text} as row from ({source}) r_{name}"

    top = "select {k}, count(*) as {n} from ue where {w} group by {k} order by {n} desc, {k} limit 10"
    summary = {
        "total_registered_customers": "count(distinct user_id)", "total_events": "count(*)",
        "total_anonymous_visitors": "count(distinct case when user_id is null then visitor_id end)",
        "total_customers": "count(distinct coalesce(user_id, visitor_id))",
        "total_views": "count(*) filter (where event_type = 'view')",
        "total_add_to_cart": "count(*) filter (where event_type = 'add_to_cart')",
        "total_purchases": "count(*) filter (where event_type = 'transaction')",
        "total_refunds": "count(*) filter (where event_type = 'refund_request')",
        "recommendations_generated": "(select count(*) from rec)",
        "notifications_generated": "(select count(*) from notif)"}
    by_type = "select event_type, count(*) as event_count from {t} group by event_type"
    parts = [
        row("summary", summary, "select " + ", ".join(f"{v} as {k}" for k, v in summary.items()) + " from ue"),
        row("events_by_type", ["event_type", "event_count"], by_type.format(t="ue")),
        row("top_viewed_products", ["product_id", "view_count"], top.format(k="product_id", n="view_count", w="event_type = 'view'")),
        row("top_cart_products", ["product_id", "add_to_cart_count"], top.format(k="product_id", n="add_to_cart_count", w="event_type = 'add_to_cart'")),
        row("top_purchased_products", ["product_id", "purchase_count"], top.format(k="product_id", n="purchase_count", w="event_type = 'transaction'")),
        row("most_active_users", ["user_id", "event_count"], top.format(k="user_id", n="event_count", w="user_id is not null")),
        row("most_active_visitors", ["visitor_id", "event_count"], top.format(k="visitor_id", n="event_count", w="user_id is null")),
        row("recommendation_event_counts", ["event_type", "event_count"], by_type.format(t="rec")),
        row("notification_counts", ["event_type", "event_count"], by_type.format(t="notif")),
    ]
    return "\nunion all ".join(parts)


register("json_report_sink", q(f"select report, row, (select max(event_date) from ue)::varchar as run_date from ({_report_rows()}) x"))


def _live_rows() -> str:
    from ..streaming.metrics import METRICS

    key = {"total": "'all'", "minute": "strftime(time_bucket(interval 1 minute, event_time), '%Y-%m-%d %H:%M:%S')"}
    out = []
    for m in METRICS:
        where = f" where event_type = '{m.event_type}'" if m.event_type else ""
        k = key.get(m.group, m.group)
        group = "" if m.group == "total" else f" group by {k}"
        out.append(f"select '{m.name}' as metric, {k} as k, count(*) as value from {_TOPIC_CTE[m.topic]}{where}{group}")
    return "\nunion all ".join(out)


register("live_metrics_job", q(_live_rows()))


register("value_model_split", q("""
select user_id, cast(value_label as integer) as value_label,
  row_number() over (partition by value_label order by md5('42:' || user_id), user_id) - 1
    < round(count(*) over (partition by value_label) * 0.2) as is_test
from labeled""", VALUE_CTES))
register("prediction_metrics", q("""
select label, round(precision, 6) as precision, round(recall, 6) as recall, round(f1, 6) as f1, support,
  round(sum(tp) over () / sum(support) over (), 6) as accuracy, round(avg(f1) over (), 6) as macro_f1,
  round(sum(f1 * support) over () / sum(support) over (), 6) as weighted_f1
from (select *, case when tp > 0 then 2 * precision * recall / (precision + recall) else 0.0 end as f1
  from (select *, case when said > 0 then tp / said else 0.0 end as precision, case when support > 0 then tp / support else 0.0 end as recall
    from (select label, count(*) filter (where y = label) as support, count(*) filter (where p = label) as said,
            count(*) filter (where y = label and p = label) as tp
          from (select unnest([0, 1, 2])::integer as label) c cross join (
            select cast(value_label as integer) as y,
              case when transaction_count >= 19 then 2 when transaction_count >= 15 then 1 else 0 end as p from labeled) x
          group by label) a where support + said > 0) b) d""", VALUE_CTES))

_UNLABELED = """su_ids as (select cast(id as varchar) as user_id from su),
unlabeled as (
  select u.user_id, (select count(*) from cart c where c.user_id = u.user_id) as add_count
  from su_ids u where u.user_id not in (select user_id from labeled))
"""
register("value_model_invariants", q("""
select 'predicted' as kind, user_id as key, cast(value_label as bigint) as value from split where is_test
union all select 'support', cast(value_label as varchar), count(*) from split where is_test group by value_label
union all select 'features', 'all', 14
union all select 'fold', cast(k % 5 as varchar) || '/' || cast(value_label as varchar), count(*) from split group by k % 5, value_label
union all select 'scored', user_id, add_count from unlabeled""", CART_CTES + """,
split as (
  select user_id, cast(value_label as integer) as value_label, k, k < round(n * 0.2) as is_test from (
    select user_id, value_label, count(*) over (partition by value_label) as n,
      row_number() over (partition by value_label order by md5('42:' || user_id), user_id) - 1 as k from labeled) r),
""" + _UNLABELED))
register("champion_of_fits", q("""
select state, n_runs, true as best, user_id, true as by_champion, true as labeled
from unlabeled cross join (values ('fitted', 3::bigint), ('rolled back', 2::bigint)) s(state, n_runs)""", CART_CTES + """,
""" + _UNLABELED))
