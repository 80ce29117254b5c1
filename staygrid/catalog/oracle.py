"""DuckDB SQL for every named query."""

from __future__ import annotations

import re

from staygrid.catalog import inputs
from staygrid.catalog.fixtures import VIEWS, with_views

US = "epoch_us"


def compose(main: str, **ctes: str) -> str:
    """One statement: the fixture views in use, then ``ctes``, then ``main``."""
    texts = " ".join([main, *ctes.values()])
    head = with_views(f"/*views*/ {' '.join(v for v in VIEWS if re.search(rf'\b{v}\b', texts))}")
    prefix = head.split("/*views*/")[0].strip()
    own = ", ".join(f"{name} as ({text})" for name, text in ctes.items())
    if prefix and own:
        return f"{prefix}, {own} {main}"
    if own:
        return f"with {own} {main}"
    return f"{prefix} {main}" if prefix else main


def geodesic(source: str, keep: str, passes: int = 6) -> dict[str, str]:
    """CTEs g0..gN over ``source`` (req_lat, req_lng, lat, lng); the last is ``geo``."""
    f = 1 / 298.257223563
    a = 6378137.0
    b = a * (1 - f)
    ctes = {
        "g0": f"select *, atan((1-{f!r})*tan(radians(req_lat))) as u1, "
        f"atan((1-{f!r})*tan(radians(lat))) as u2, radians(lng-req_lng) as dl from {source}",
        "l0": "select *, sin(u1) as s1, cos(u1) as c1, sin(u2) as s2, cos(u2) as c2, dl as lam from g0",
    }
    for i in range(passes + 1):
        ctes[f"p{i}"] = (
            "select *, sqrt((c2*sin(lam))*(c2*sin(lam)) + (c1*s2-s1*c2*cos(lam))*(c1*s2-s1*c2*cos(lam))) as ss, "
            f"s1*s2+c1*c2*cos(lam) as cs from l{i}"
        )
        ctes[f"q{i}"] = (
            "select *, atan2(ss, cs) as sg, case when ss = 0 then 0 else c1*c2*sin(lam)/ss end as sa "
            f"from p{i}"
        )
        ctes[f"r{i}"] = (
            "select *, 1-sa*sa as ca, case when 1-sa*sa = 0 then 0 else cs-2*s1*s2/(1-sa*sa) end as cm "
            f"from q{i}"
        )
        if i < passes:
            ctes[f"l{i + 1}"] = (
                "select * exclude (lam, ss, cs, sg, sa, ca, cm, cc), "
                f"dl+(1-cc)*{f!r}*sa*(sg+cc*ss*(cm+cc*cs*(2*cm*cm-1))) as lam "
                f"from (select *, {f!r}/16*ca*(4+{f!r}*(4-3*ca)) as cc from r{i})"
            )
    ctes["gz"] = (
        "select *, 1+uu/16384*(4096+uu*(-768+uu*(320-175*uu))) as ba, "
        "uu/1024*(256+uu*(-128+uu*(74-47*uu))) as bb "
        f"from (select *, ca*({a!r}*{a!r}-{b!r}*{b!r})/({b!r}*{b!r}) as uu from r{passes})"
    )
    keep_columns = ", ".join(c.strip() for c in keep.split(","))
    ctes["geo"] = (
        f"select {keep_columns}, {b!r}*ba*(sg - bb*ss*(cm+bb/4*(cs*(2*cm*cm-1)"
        "-bb/6*cm*(4*ss*ss-3)*(4*cm*cm-3)))) as distance_m from gz"
    )
    return ctes


DISPLAY = (
    "coalesce(l.gender_preference, 'COED') as gender_preference, coalesce(l.pg_type, 'PG') as pg_type, "
    "coalesce(l.food_type, 'BOTH') as food_type, coalesce(cast(l.avg_rating as double), 0) as avg_rating, "
    "coalesce(l.review_count, 0) as review_count"
)
CARD = f"l.title, l.locality, l.address_line, l.lat, l.lng, {DISPLAY}"
MIN_RENT = "(select min(monthly_rent) from rooms_v r where r.listing_id = l.id) as min_rent"
COVERS = (
    "select listing_id, url as cover_photo from (select *, row_number() over (partition by listing_id "
    "order by display_order asc nulls last, id) as rn from photos_v) where rn = 1"
)
RATING = (
    "cast((({n} > 0)::int * ((((200 * {s} + {n}) // (2 * greatest({n}, 1))) + 5) // 10)) as double) / 10"
)


def rating(total: str, count: str) -> str:
    return RATING.format(s=total, n=count)


P = inputs.POINT_FILTERS
BOX = (
    "lat between req_lat - radius_m * 1.02 / 110574 and req_lat + radius_m * 1.02 / 110574 "
    "and lng between req_lng - radius_m * 1.03 / (111320 * cos(radians(req_lat))) "
    "and req_lng + radius_m * 1.03 / (111320 * cos(radians(req_lat)))"
)
POINT_PAIRS = (
    f"select l.*, {P['lat']} as req_lat, {P['lng']} as req_lng, {P['radius_km'] * 1000} as radius_m "
    f"from listings_v l where status = 'ACTIVE' and gender_preference = '{P['gender'].upper()}' "
    f"and exists (select 1 from rooms_v r where r.listing_id = l.id and monthly_rent >= {P['low']} "
    f"and monthly_rent <= {P['high']})"
)
VALID = (
    "select *, radius_km * 1000 as radius_m, lat as req_lat, lng as req_lng, "
    "greatest(1, least(50, size)) as n from search_requests_v "
    "where lat between 8 and 37 and lng between 68 and 98"
)


def _clean(column: str) -> str:
    return f"regexp_replace(upper(q.{column}), '[^A-Z_]', '', 'g')"


CANDIDATES = (
    "select q.request_id, q.user_id, q.req_lat, q.req_lng, q.radius_m, q.page, q.n, l.id as listing_id, "
    "l.lat, l.lng from valid q join listings_v l on "
    + BOX.replace("lat between", "l.lat between", 1).replace("lng between", "l.lng between", 1)
    + " where l.status = 'ACTIVE' "
    f"and (q.gender is null or l.gender_preference = {_clean('gender')}) "
    f"and (q.food is null or l.food_type = {_clean('food')}) "
    f"and (q.pg_type is null or l.pg_type = {_clean('pg_type')}) "
    "and ((q.min_rent is null and q.max_rent is null) or exists (select 1 from rooms_v r "
    "where r.listing_id = l.id and (q.min_rent is null or r.monthly_rent >= q.min_rent) "
    "and (q.max_rent is null or r.monthly_rent <= q.max_rent)))"
)
KEEP = "request_id, user_id, radius_m, page, n, listing_id"
BATCH = {
    "valid": VALID, "cand": CANDIDATES, **geodesic("cand", KEEP),
    "hits": "select * from geo where distance_m <= radius_m",
    "ranked": "select *, row_number() over (partition by request_id order by distance_m, listing_id) as position, "
    "count(*) over (partition by request_id) as total from hits",
    "paged": "select * from ranked where position > page * n and position <= (page + 1) * n",
}
SPHERE = (
    "2 * 6371008.8 * asin(sqrt(least(1.0, pow(sin((radians(lat) - radians(req_lat)) / 2), 2) + "
    "cos(radians(req_lat)) * cos(radians(lat)) * pow(sin((radians(lng) - radians(req_lng)) / 2), 2))))"
)

FAVORITE_FOLD = """
select user_id, listing_id, epoch_us(min(ts)) as created_at from (
  select e.*, max(case when op = 'remove' then {order} end) over (partition by user_id, listing_id) as cut
  from favorite_events_v e) where op = 'add' and (cut is null or {order} > cut)
group by user_id, listing_id
"""
ORDER = "struct_pack(a := ts, b := event_id)"
REVIEW_LATER = """
select * from (
  select e.*, max(case when op = 'delete' then {order} end) over (partition by user_id, listing_id) as cut
  from review_events_v e) where op = 'upsert' and (cut is null or {order} > cut)
"""
REVIEW_STATE = """
select user_id, listing_id, min_by(event_id, {order}) as id, max_by(rating, {order}) as rating,
  max_by(comment, {order}) as comment, max(ts) as created_at
from later group by user_id, listing_id
"""
REVIEWS = {"later": REVIEW_LATER.format(order=ORDER), "state": REVIEW_STATE.format(order=ORDER)}
REVIEW_FOLD = compose(
    "select id, user_id, listing_id, rating, comment, false as is_flagged, epoch_us(created_at) as created_at from state",
    **REVIEWS,
)
INQUIRY_FOLD = (
    "select tenant_id, listing_id, {extra} epoch_us(min(ts)) as created_at, "
    "epoch_us(max(ts)) as last_attempt_at from inquiry_events_v group by tenant_id, listing_id"
)
USER_FOLD = compose(
    "select {extra}firebase_uid, coalesce(phone, concat('email:', firebase_uid)) as phone, role, full_name, "
    "false as is_verified, epoch_us(ts) as created_at from (select *, row_number() over "
    "(partition by firebase_uid order by ts, event_id) as rn from user_events_v) where rn = 1"
)
SUMMARY = """
select owner_id, position, listing_id, listing_title, unique_inquirers, epoch_us(last_inquiry_at) as last_inquiry_at
from (select *, row_number() over (partition by owner_id order by last_inquiry_at desc nulls first, listing_id) as position
  from (select l.owner_id, l.id as listing_id, l.title as listing_title,
    cast(count(distinct i.tenant_id) as int) as unique_inquirers, max(i.last_attempt_at) as last_inquiry_at
    from inquiries_v i join listings_v l on l.id = i.listing_id group by l.owner_id, l.id, l.title))
where position <= 100
"""
SHARING = "('SINGLE', 'DOUBLE', 'TRIPLE', 'QUAD')"
DRAFT_REASON = {
    "broken": f"""
select draft_id, min_by(why, pos) as room_reason from (select *, case
    when sharing_type is null or sharing_type not in {SHARING} then 'sharing_type'
    when monthly_rent <= 0 then 'rent' when available_beds > total_beds then 'beds' end as why
  from draft_rooms_v) where why is not null group by draft_id
""",
    "judged": """
select d.*, case when trim(title) = '' then 'title' when trim(address_line) = '' then 'address'
  when trim(locality) = '' then 'locality'
  when gender_preference not in ('MALE', 'FEMALE', 'COED') then 'gender_preference'
  when pg_type not in ('PG', 'HOSTEL', 'COLIVING') then 'pg_type'
  when food_type not in ('VEG', 'NON_VEG', 'BOTH', 'NONE') then 'food_type'
  when latitude not between -90 and 90 or longitude not between -180 and 180 then 'coordinates'
  else room_reason end as reason
from listing_drafts_v d left join broken using (draft_id)
""",
    "good": "select * from judged where reason is null and amenity_id in (select id from amenities_v)",
}
REPLACING = DRAFT_REASON | {
    "swap": "select g.* from good g join listings_v l on l.id = g.draft_id and l.owner_id = g.owner_id",
}
AVAILABILITY = """
select e.*, r.total_beds, case when l.id is null then 'listing not found'
  when l.owner_id is distinct from e.actor_id then 'not the owner'
  when r.id is null then 'room not found' when l.status is distinct from 'ACTIVE' then 'listing not active'
  when e.available_beds is null or e.available_beds < 0 or e.available_beds > r.total_beds
    then 'available beds out of range' end as reason
from availability_events_v e left join listings_v l on l.id = e.listing_id
left join rooms_v r on r.id = e.room_id and r.listing_id = e.listing_id
"""
UPLOADS = {
    "counts": "select listing_id, count(*) as photo_count from photos_v group by listing_id",
    "checked": """
select m.*, coalesce(photo_count, 0) as have, case when content_type not like 'image/%' then 'content type'
  when lower(regexp_extract(file_name, '\\.([^.]*)$', 1)) not in ('jpg', 'jpeg', 'png', 'webp') then 'extension'
  when size_bytes > 5242880 then 'too large' end as file_reason
from photo_meta_v m left join counts using (listing_id)
""",
    "counted": """
select *, count(case when file_reason is null then 1 end) over (partition by listing_id
  order by uploaded_at, upload_key rows between unbounded preceding and 1 preceding) as good_before from checked
""",
    "placed": """
select *, case when have + good_before >= 6 then 'too many photos' else file_reason end as reason,
  case when have + good_before < 6 and file_reason is null then cast(have + good_before as int) end as display_order
from counted
""",
}
COVER_ONE = {
    "chosen": "select p.listing_id, p.id as photo, p.display_order as old from photos_v p "
    "join pick on pick.listing_id = p.listing_id and pick.photo_id = p.id where coalesce(p.display_order, 0) <> 0",
}
COVER_MANY = {
    "turns": """
select listing_id, photo_id, row_number() over (partition by listing_id order by ts, event_id) as turn
from cover_events_v e where exists (select 1 from photos_v p where p.listing_id = e.listing_id and p.id = e.photo_id)
""",
    "shelves": "select listing_id, list(struct_pack(id := id, place := display_order) order by id) as shelf "
    "from photos_v group by listing_id",
    "walk": """
select listing_id, 0 as step, shelf from shelves where listing_id in (select listing_id from turns)
union all
select w.listing_id, w.step + 1, case when coalesce(list_filter(w.shelf, lambda p: p.id = t.photo_id)[1].place, 0) = 0
  then w.shelf else list_transform(w.shelf, lambda p: struct_pack(id := p.id, place :=
    case when p.id = t.photo_id then 0
      when p.place >= 0 and p.place < list_filter(w.shelf, lambda z: z.id = t.photo_id)[1].place then p.place + 1
      else p.place end)) end
from walk w join turns t on t.listing_id = w.listing_id and t.turn = w.step + 1
""",
    "final": "select listing_id, max_by(shelf, step) as shelf from walk group by listing_id",
    "spread": "select listing_id, unnest(shelf) as p from final",
}
LOAD_OF = {
    "users": "users_load_v", "listings": "listings_load_v", "room_options": "rooms_load_v",
    "favorites": "favorites_load_v", "reviews": "reviews_load_v", "inquiries": "inquiries_load_v",
    "listing_amenities": "listing_amenities_v", "amenities": "amenities_v",
}


def _duplicates(table: str, *columns: str) -> str:
    text = " || '|' || ".join(f"cast({c} as varchar)" for c in columns)
    present = " and ".join(f"{c} is not null" for c in columns)
    return (
        f"select '{table}' as table_name, '{','.join(columns)}' as key, {text} as value, count(*) as rows "
        f"from {LOAD_OF[table]} where {present} group by {', '.join(columns)} having count(*) > 1"
    )


def _orphans(child: str, column: str, parent: str) -> str:
    return (
        f"select '{child}' as table_name, '{column}' as column_name, cast({column} as varchar) as value, "
        f"count(*) as rows from {LOAD_OF[child]} where {column} is not null and {column} not in "
        f"(select id from {LOAD_OF[parent]} where id is not null) group by {column}"
    )


def _outside(table: str, column: str, domain: str) -> str:
    return (
        f"select '{table}' as table_name, '{column}' as column_name, cast({column} as varchar) as value, "
        f"count(*) as rows from {LOAD_OF[table]} where {column} not in ({domain}) group by {column}"
    )


def _nulls(table: str, *columns: str) -> str:
    return " union all ".join(
        f"select '{table}' as table_name, '{c}' as column_name, count(*) as nulls from {LOAD_OF[table]} "
        f"where {c} is null having count(*) > 0"
        for c in columns
    )


def _union(*parts: str) -> str:
    return " union all ".join(parts)


BACKFILL = {
    "targets": inputs.RATING_TARGETS,
    "pool": inputs.COMMENT_POOL,
    "matched": "select l.id as listing_id, ratings, row_number() over (order by t.title, l.id) - 1 as off "
    "from targets t join listings_v l on l.title = t.title",
    "expanded": "select listing_id, off, unnest(string_split(ratings, ',')) as r, "
    "unnest(range(1, len(string_split(ratings, ',')) + 1)) as pos from matched",
    "people": "select id, row_number() over (order by firebase_uid) as un from users_v where firebase_uid like 'uid-%'",
    "keyed": "select listing_id, cast(r as int) as rating, (off + pos - 1) % (select count(*) from people) + 1 as un, "
    "row_number() over (partition by r order by listing_id, pos) as rk, "
    "row_number() over (order by listing_id, pos) as seq from expanded",
    "made": f"select k.listing_id, p.id as user_id, k.rating, c.comment, timestamp '{inputs.AS_OF_TIME}' "
    "- to_seconds(cast(k.seq * 86400 + (k.seq * 7 % 24) * 3600 as bigint)) as created_at, "
    "k.seq from keyed k join people p on p.un = k.un "
    "join pool c on c.rating = k.rating and c.ord = k.rk",
    "added": "select * from made m where not exists (select 1 from reviews_v x "
    "where x.listing_id = m.listing_id and x.user_id = m.user_id)",
}


def _draw(tag: str, *columns: str) -> str:
    text = ", ':', ".join([f"'{inputs.SEED}:{tag}'", *[f"cast({c} as varchar)" for c in columns]])
    return f"(cast(('0x' || substr(md5(concat({text})), 1, 8)) as bigint) / 4294967296.0)"


def _span(low: int, span: int, tag: str) -> str:
    return f"cast({low} + floor({_draw(tag, 'id')} * {span} + 0.5) as int)"


AGE = (
    "(year(d'{0}') - year(day) - case when month(d'{0}') * 100 + day(d'{0}') < month(day) * 100 + day(day) "
    "then 1 else 0 end)"
)

ORACLE: dict[str, str] = {
    "search_point": compose(
        f"select l.id as listing_id, {CARD}, {MIN_RENT}, c.cover_photo, round(distance_m, 3) as distance_m, "
        f"exists (select 1 from favorites_v f where f.listing_id = l.id and f.user_id = {inputs.POINT_REQUEST['user_id']}) "
        "as is_favorite from hits h join listings_v l on l.id = h.id left join covers c on c.listing_id = l.id "
        f"order by h.distance_m, l.id limit {inputs.POINT_REQUEST['size']}",
        cand=POINT_PAIRS, **geodesic("cand", "id, radius_m"),
        hits="select * from geo where distance_m <= radius_m", covers=COVERS,
    ),
    "search_point_total": compose(
        "select cast(count(*) as int) as total from geo where distance_m <= radius_m",
        cand=POINT_PAIRS, **geodesic("cand", "id, radius_m"),
    ),
    "search_rent_semi": compose(
        "select distinct l.id, l.title from listings_v l join rooms_v r on r.listing_id = l.id "
        f"where l.status = 'ACTIVE' and r.monthly_rent >= {inputs.RENT_BOUNDS[0]} and r.monthly_rent <= {inputs.RENT_BOUNDS[1]}"
    ),
    "search_category": compose(
        "select id, gender_preference, food_type, coalesce(pg_type, 'PG') as pg_type from listings_v "
        "where status = 'ACTIVE' and gender_preference = 'FEMALE' and food_type = 'VEG'"
    ),
    "search_batch_page": compose(
        f"select p.request_id, p.position, p.page, p.total, p.listing_id, {CARD}, {MIN_RENT}, c.cover_photo, "
        "round(p.distance_m, 3) as distance_m, exists (select 1 from favorites_v f where f.listing_id = p.listing_id "
        "and f.user_id = p.user_id) as is_favorite from paged p join listings_v l on l.id = p.listing_id "
        "left join covers c on c.listing_id = l.id",
        **BATCH, covers=COVERS,
    ),
    "search_batch_sphere": compose(
        "select request_id, position, listing_id, round(distance_m, 3) as distance_m from ranked "
        "where position > page * n and position <= (page + 1) * n",
        valid=VALID, cand=CANDIDATES,
        hits=f"select * from (select *, {SPHERE} as distance_m from cand) where distance_m <= radius_m",
        ranked=BATCH["ranked"],
    ),
    "search_batch_total": compose(
        "select v.request_id, cast(count(h.listing_id) as int) as total from valid v left join hits h "
        "on h.request_id = v.request_id group by v.request_id",
        **{k: v for k, v in BATCH.items() if k not in ("ranked", "paged")},
    ),
    "radius_join_pairs": compose(
        "select request_id, listing_id, round(distance_m, 3) as distance_m from geo where distance_m <= radius_m",
        asked="select request_id, lat as req_lat, lng as req_lng, radius_km * 1000 as radius_m from search_requests_v",
        cand="select q.*, l.id as listing_id, l.lat, l.lng from asked q join listings_v l on "
        + BOX.replace("lat between", "l.lat between", 1).replace("lng between", "l.lng between", 1),
        **geodesic("cand", "request_id, listing_id, radius_m"),
    ),
    "geodesic_distance": compose(
        "select id, round(distance_m, 3) as distance_m from geo",
        cand="select q.request_id as id, q.lat as req_lat, q.lng as req_lng, l.lat, l.lng "
        "from search_requests_v q join listings_v l on l.id = q.request_id",
        **geodesic("cand", "id"),
    ),
    "geodesic_far": compose(
        "select id, round(distance_m, 3) as distance_m from geo",
        cand=inputs.FAR_PAIRS, **geodesic("cand", "id", 20),
    ),
    "normalise_requests": compose(
        """select request_id, case when lat <> 'north' then cast(lat as double) end as lat,
  cast(trim(lng) as double) as lng,
  cast(case when radius_km in ('2.5', '2.5f') then '2.5' when radius_km like '-1e2D%' then '-100' else '5' end as double) as radius_km,
  case when regexp_full_match(min_rent, '[+-]?[0-9]+') then try_cast(replace(min_rent, '+', '') as int) end as min_rent,
  case when regexp_full_match(max_rent, '[+-]?[0-9]+') then try_cast(max_rent as int) end as max_rent,
  case when page = '1' then 1 else 0 end as page,
  greatest(1, least(50, coalesce(try_cast(size as int), 20))) as size from raw""",
        raw=inputs.RAW_REQUESTS,
    ),
    "cover_photo": compose(COVERS),
    "min_rent": compose(
        "select l.id, min(r.monthly_rent) as min_rent, cast(count(r.id) as int) as room_count "
        "from listings_v l left join rooms_v r on r.listing_id = l.id group by l.id"
    ),
    "photo_count": compose(
        "select listing_id, cast(count(*) as int) as photo_count from photos_v group by listing_id"
    ),
    "listing_core": compose(
        f"select l.id as listing_id, l.id % 150 as user_id, l.title, {DISPLAY}, l.status, l.owner_id, "
        "u.full_name as owner_name, coalesce(l.contact_phone, u.phone) as owner_phone, "
        "coalesce(u.is_verified, false) as owner_verified, f.user_id is not null as is_favorite "
        "from listings_v l join users_v u on u.id = l.owner_id left join favorites_v f "
        "on f.listing_id = l.id and f.user_id = l.id % 150 where l.status <> 'DELETED'"
    ),
    "listing_rooms": compose(
        "select listing_id, id, coalesce(sharing_type, 'DOUBLE') as sharing_type, monthly_rent, total_beds, "
        "available_beds, coalesce(notice_period_days, 0) as notice_period_days from rooms_v"
    ),
    "listing_photos": compose(
        "select listing_id, id, url, url as thumbnail_url, coalesce(display_order, 0) as display_order from photos_v"
    ),
    "listing_amenities": compose(
        "select la.listing_id, la.amenity_id, a.name, a.icon_key from listing_amenities_v la "
        "join amenities_v a on a.id = la.amenity_id"
    ),
    "recent_reviews": compose(
        "select listing_id, position, id, user_id, user_name, rating, comment, epoch_us(created_at) as created_at from "
        "(select r.*, u.full_name as user_name, row_number() over (partition by listing_id "
        "order by r.created_at desc nulls first, r.id) as position from reviews_v r join users_v u on u.id = r.user_id "
        "where r.is_flagged = false) where position <= 5"
    ),
    "listing_documents": compose(
        f"""select l.id, l.title, 'Bengaluru' as city, l.status, coalesce(l.gender_preference, 'COED') as gender_preference,
  cast(l.avg_rating as double) as avg_rating, l.review_count, l.owner_id,
  coalesce(l.contact_phone, u.phone) as owner_phone,
  coalesce((select string_agg(concat(id, ':', coalesce(sharing_type, 'DOUBLE'), ':', monthly_rent, ':',
    coalesce(notice_period_days, 0)), ',' order by monthly_rent, id) from rooms_v r where r.listing_id = l.id), '') as room_options,
  coalesce((select string_agg(concat(id, ':', url, ':', coalesce(display_order, 0)), ',' order by display_order asc nulls last, id)
    from photos_v p where p.listing_id = l.id), '') as photos,
  coalesce((select string_agg(concat(a.id, ':', a.name, ':', a.icon_key), ',' order by a.name)
    from listing_amenities_v la join amenities_v a on a.id = la.amenity_id where la.listing_id = l.id), '') as amenities,
  coalesce((select string_agg(concat(id, ':', user_id, ':', rating, ':', comment), ',' order by position)
    from recent x where x.listing_id = l.id), '') as recent_reviews
from listings_v l join users_v u on u.id = l.owner_id where l.status <> 'DELETED'""",
        recent="select * from (select r.*, row_number() over (partition by listing_id order by r.created_at desc nulls first, r.id) "
        "as position from reviews_v r join users_v u on u.id = r.user_id where r.is_flagged = false) where position <= 5",
    ),
    "owner_portfolio": compose(
        "select l.owner_id, l.id, l.title, l.locality, l.gender_preference, l.pg_type, l.status, "
        "coalesce(cast(l.avg_rating as double), 0) as avg_rating, coalesce(l.review_count, 0) as review_count, "
        "min(r.monthly_rent) as min_rent, cast(count(r.id) as int) as room_count, epoch_us(l.created_at) as created_at "
        "from listings_v l left join rooms_v r on r.listing_id = l.id where l.status <> 'DELETED' "
        "group by all"
    ),
    "inquiries_on_listings": compose(
        "select l.id as listing_id, cast(count(distinct i.tenant_id) as int) as unique_inquirers, "
        "epoch_us(max(i.last_attempt_at)) as last_inquiry_at, l.owner_id, l.title as listing_title "
        "from inquiries_v i join listings_v l on l.id = i.listing_id group by l.id, l.owner_id, l.title"
    ),
    "inquiry_summary": compose(SUMMARY),
    "favorites_list": compose(
        f"select f.user_id, f.listing_id, {CARD}, {MIN_RENT}, c.cover_photo, cast(null as double) as distance_m, "
        "true as is_favorite, epoch_us(f.created_at) as created_at from favorites_v f join listings_v l "
        "on l.id = f.listing_id left join covers c on c.listing_id = l.id where l.status = 'ACTIVE'",
        covers=COVERS,
    ),
    "listing_ratings": compose(
        f"select listing_id, {rating('sum(rating)', 'count(*)')} as avg_rating, cast(count(*) as int) as review_count "
        "from reviews_v group by listing_id"
    ),
    "rating_drift": compose(
        "select * from (select l.id, cast(l.avg_rating as double) as avg_rating, l.review_count, "
        f"{rating('coalesce(s, 0)', 'coalesce(n, 0)')} as true_rating, cast(coalesce(n, 0) as int) as true_count "
        "from listings_v l left join sums on sums.listing_id = l.id) "
        "where avg_rating is distinct from true_rating or review_count is distinct from true_count",
        sums="select listing_id, sum(rating) as s, count(*) as n from reviews_v group by listing_id",
    ),
    "user_profiles": compose(
        "select id, u.firebase_uid, cast(null as varchar) as email, phone, full_name, role, is_verified, gender, "
        "cast(dob as varchar) as dob from users_v u where firebase_uid in (select firebase_uid from uids)",
        uids=inputs.PROFILE_UIDS,
    ),
    "status_lookup": compose(
        "select e.event_id, e.listing_id, e.photo_id, l.owner_id, l.status, l.status = 'ACTIVE' as is_active, "
        "cast((select count(*) from photos_v p where p.listing_id = l.id) as int) as photo_count, "
        "p.url as photo_url, case when p.id is not null then coalesce(p.display_order, 0) end as photo_order "
        "from cover_events_v e join listings_v l on l.id = e.listing_id "
        "left join photos_v p on p.listing_id = e.listing_id and p.id = e.photo_id"
    ),
    "only_reviewed": compose(
        "select id, title from listings_v where id in (select distinct listing_id from reviews_v)"
    ),
    "newest_listings": compose(
        "select id, status, epoch_us(created_at) as created_at from listings_v where status <> 'DELETED' "
        "order by listings_v.created_at desc nulls first, id"
    ),
    "fold_favorites": compose(FAVORITE_FOLD.format(order=ORDER)),
    "fold_favorites_on_prior": compose(FAVORITE_FOLD.format(order=ORDER)),
    "fold_reviews": REVIEW_FOLD,
    "fold_inquiries": compose(INQUIRY_FOLD.format(extra=f"min_by(event_id, {ORDER}) as id, 'PENDING' as status,")),
    "fold_reviews_on_prior": compose(
        "select kept.id, user_id, listing_id, last.rating, last.comment, kept.is_flagged, epoch_us(last.created_at) as created_at "
        "from (select user_id, listing_id, min_by(struct_pack(id := id, is_flagged := is_flagged), struct_pack(c := age, a := ts, b := event_id)) as kept, "
        f"max_by(struct_pack(rating := rating, comment := comment, created_at := ts), {ORDER}) as last from later group by user_id, listing_id)",
        prior=inputs.PRIOR_REVIEWS,
        log="select -1 as event_id, created_at as ts, user_id, listing_id, 'upsert' as op, rating, comment, id, is_flagged, 0 as age from prior "
        "union all select event_id, ts, user_id, listing_id, op, rating, comment, event_id, false, 1 from review_events_v "
        f"where not ({inputs.FIRST_BATCH})",
        later=REVIEW_LATER.format(order=ORDER).replace("review_events_v", "log"),
    ),
    "fold_inquiries_on_prior": compose(
        "select text.id as id, tenant_id, listing_id, text.message as message, text.status as status, first_at as created_at, last_at as last_attempt_at "
        "from (select tenant_id, listing_id, min_by(struct_pack(id := id, message := message, status := status), "
        "struct_pack(c := age, a := created_at, b := event_id)) as text, epoch_us(min(created_at)) as first_at, "
        "epoch_us(max(last_attempt_at)) as last_at from log group by tenant_id, listing_id)",
        prior=inputs.PRIOR_INQUIRIES,
        log="select id, tenant_id, listing_id, message, status, created_at, last_attempt_at, 0 as age, -1 as event_id from prior union all "
        "select event_id, tenant_id, listing_id, null, 'PENDING', ts, ts, 1, event_id from inquiry_events_v "
        f"where not ({inputs.FIRST_BATCH})",
    ),
    "fold_users_on_prior": compose(
        "select id, firebase_uid, phone, role, full_name, is_verified, profile_photo_url, epoch_us(created_at) as created_at, "
        "epoch_us(updated_at) as updated_at from prior union all select event_id, firebase_uid, "
        "coalesce(phone, concat('email:', firebase_uid)), role, full_name, false, null, epoch_us(ts), null from "
        "(select *, row_number() over (partition by firebase_uid order by ts, event_id) as rn from user_events_v e "
        "where phone is null or phone not in (select phone from prior)) where rn = 1",
        prior=inputs.PRIOR_USERS,
    ),
    "inquiry_summary_all": compose(
        "select l.owner_id, l.id as listing_id, l.title as listing_title, "
        "cast(count(distinct i.tenant_id) as int) as unique_inquirers, epoch_us(max(i.last_attempt_at)) as last_inquiry_at "
        "from inquiries_v i join listings_v l on l.id = i.listing_id group by l.owner_id, l.id, l.title"
    ),
    "fold_users": USER_FOLD.format(extra="event_id as id, "),
    "refresh_ratings": compose(
        "select l.id, case when c.listing_id is null then cast(l.avg_rating as double) else "
        f"{rating('coalesce(s, 0)', 'coalesce(n, 0)')} end as avg_rating, "
        "case when c.listing_id is null then l.review_count else cast(coalesce(n, 0) as int) end as review_count "
        "from listings_v l left join changed c on c.listing_id = l.id left join sums on sums.listing_id = l.id",
        **REVIEWS,
        sums="select listing_id, sum(rating) as s, count(*) as n from state group by listing_id",
        changed="select distinct listing_id from (select listing_id from review_events_v where op = 'upsert' union all "
        "select listing_id from reviews_v b where not exists (select 1 from state a where a.user_id = b.user_id "
        "and a.listing_id = b.listing_id))",
    ),
    "create_listings": compose(
        "select g.draft_id as listing_id, g.owner_id, g.title, 'Bengaluru' as city, cast(g.latitude as double) as lat, cast(g.longitude as double) as lng, "
        "'ACTIVE' as status, cast(0 as double) as avg_rating, 0 as review_count, "
        "(select cast(count(*) as int) from draft_rooms_v r where r.draft_id = g.draft_id having count(*) > 0) as rooms, "
        "(select cast(sum(monthly_rent) as bigint) from draft_rooms_v r where r.draft_id = g.draft_id) as rent_sum, "
        "g.amenity_id as amenity from good g",
        **DRAFT_REASON,
    ),
    "replace_listings": compose(
        "select l.id, l.owner_id, case when s.draft_id is null then l.title else s.title end as title, "
        "case when s.draft_id is null then l.address_line else s.address_line end as address_line, "
        "case when s.draft_id is null then l.lat else cast(s.latitude as double) end as lat, "
        "case when s.draft_id is null then l.lng else cast(s.longitude as double) end as lng, "
        "case when s.draft_id is null then l.gender_preference else s.gender_preference end as gender_preference, "
        "case when s.draft_id is null then l.food_type else s.food_type end as food_type, l.status, "
        "cast(l.avg_rating as double) as avg_rating, l.review_count, epoch_us(l.created_at) as created_at, "
        f"case when s.draft_id is not null then epoch_us(timestamp '{inputs.AS_OF_TIME}') end as updated_at "
        "from listings_v l left join swap s on s.draft_id = l.id",
        **REPLACING,
    ),
    "replace_listing_rooms": compose(
        "select listing_id, sharing_type, monthly_rent, total_beds, available_beds from rooms_v "
        "where listing_id not in (select draft_id from swap) union all "
        "select draft_id, sharing_type, monthly_rent, total_beds, available_beds from draft_rooms_v "
        "where draft_id in (select draft_id from swap)",
        **REPLACING,
    ),
    "replace_listing_amenities": compose(
        "select listing_id, amenity_id from listing_amenities_v where listing_id not in (select draft_id from swap) "
        "union all select draft_id, amenity_id from swap",
        **REPLACING,
    ),
    "soft_delete": compose(
        "select l.id, case when e.ts is null then l.status else 'DELETED' end as status, epoch_us(e.ts) as updated_at "
        "from listings_v l left join (select listing_id, max(ts) as ts from cover_events_v group by listing_id) e "
        "on e.listing_id = l.id"
    ),
    "rooms_with_status": compose(
        "select r.id, r.listing_id, r.total_beds, l.owner_id, l.status as listing_status from rooms_v r "
        "join listings_v l on l.id = r.listing_id"
    ),
    "set_availability": compose(
        "select r.id, r.listing_id, r.total_beds, coalesce(v.beds, r.available_beds) as available_beds from rooms_v r "
        f"left join (select room_id, max_by(available_beds, {ORDER}) as beds from judged where reason is null "
        "group by room_id) v on v.room_id = r.id",
        judged=AVAILABILITY,
    ),
    "photo_append": compose(
        "select listing_id, upload_key as id, file_name as url, display_order from placed where reason is null",
        **UPLOADS,
    ),
    "photo_delete": compose(
        "select listing_id, id, display_order from photos_v p where not exists (select 1 from cover_events_v e "
        "where e.listing_id = p.listing_id and e.photo_id = p.id)"
    ),
    "set_cover": compose(
        "select p.listing_id, p.id, case when p.id = c.photo then 0 when p.display_order >= 0 and p.display_order < c.old "
        "then p.display_order + 1 else p.display_order end as display_order from photos_v p "
        "left join chosen c on c.listing_id = p.listing_id",
        pick=inputs.ONE_COVER_EVENT, **COVER_ONE,
    ),
    "set_cover_many": compose(
        "select p.listing_id, p.id, case when f.listing_id is null then p.display_order else s.p.place end as display_order "
        "from photos_v p left join final f on f.listing_id = p.listing_id "
        "left join spread s on s.listing_id = p.listing_id and s.p.id = p.id",
        **COVER_MANY,
    ).replace("with ", "with recursive ", 1),
    "gate_events": compose(
        """select event_id, op, actor_id, e.listing_id, case
  when op in ('review', 'review_delete', 'inquiry', 'availability', 'edit', 'soft_delete', 'photo_upload', 'photo_delete', 'cover')
    and u.role is null then 'not registered'
  when op in ('review', 'review_delete', 'inquiry') and u.role <> 'TENANT' then 'wrong role'
  when op in ('availability', 'edit', 'soft_delete', 'photo_upload', 'photo_delete', 'cover') and u.role <> 'OWNER' then 'wrong role'
  when op not in ('review_delete', 'favorite_remove') and l.id is null then 'listing not found'
  when op in ('availability', 'edit', 'soft_delete', 'photo_upload', 'photo_delete', 'cover') and l.owner_id <> actor_id then 'not the owner'
  when op in ('photo_delete', 'cover') and p.id is null then 'photo not found'
  when op in ('review', 'inquiry', 'favorite_add', 'availability', 'cover') and l.status <> 'ACTIVE' then 'listing not active' end as reason
from acts e left join listings_v l on l.id = e.listing_id left join users_v u on u.id = e.actor_id
left join photos_v p on p.listing_id = e.listing_id and p.id = e.photo_id""",
        acts=inputs.GATE_EVENTS,
    ),
    "insert_absent": compose(
        "select user_id, listing_id, epoch_us(min(created_at)) as created_at from favorites_load_v n where user_id is not null and not exists "
        "(select 1 from favorites_v f where f.user_id = n.user_id and f.listing_id = n.listing_id) group by user_id, listing_id"
    ),
    "validate_listings": compose("select draft_id, reason from judged", **DRAFT_REASON),
    "validate_reviews": compose(
        """select draft_id, listing_id, rating, cast(length(comment) as int) as comment_length, case when l.id is null then 'listing not found'
  when l.status is distinct from 'ACTIVE' then 'listing not active'
  when rating is null or rating not between 1 and 5 then 'rating'
  when comment is null or comment = '' then 'comment blank'
  when length(comment) + length(regexp_replace(comment, '[^\\x{10000}-\\x{10FFFF}]', '', 'g')) > 1000 then 'comment too long' end as reason
from (select draft_id, d.listing_id, rating, regexp_replace(comment, '^[\\s\\p{Z}]+|[\\s\\p{Z}]+$', '', 'g') as comment
  from given d) d left join listings_v l on l.id = d.listing_id""",
        given=inputs.REVIEW_DRAFTS,
    ),
    "validate_users": compose(
        f"""select uid, upper(role) as role, case when upper(role) not in ('TENANT', 'OWNER') then 'role'
  when gender not in ('MALE', 'FEMALE', 'OTHER', 'PREFER_NOT_TO_SAY') then 'gender'
  when dob is not null and not regexp_full_match(dob, '[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}') then 'dob format'
  when dob is not null and birth is null then 'dob not a date'
  when 2024 - year(birth) - (case when 101 < month(birth) * 100 + day(birth) then 1 else 0 end) < 18 then 'under age' end as reason
from (select *, try_cast(dob as date) as birth from given)""",
        given=inputs.REGISTRATIONS,
    ),
    "validate_requests": compose(
        """select request_id, coalesce(radius_km, 5.0) as radius_km, coalesce(page, 0) as page,
  greatest(1, least(50, coalesce(size, 20))) as size, case when lat is null then 'lat missing' when lng is null then 'lng missing'
  when lat not between 8 and 37 or lng not between 68 and 98 then 'outside the supported area'
  when page < 0 then 'negative page' when radius_km < 0 then 'radius' end as reason from given""",
        given=inputs.EDGE_REQUESTS,
    ),
    "validate_availability": compose("select event_id, reason from judged", judged=AVAILABILITY),
    "validate_photos": compose(
        "select listing_id, upload_key, display_order, reason from placed", **UPLOADS
    ),
    "validate_ids": compose(
        "select doc_key, case when id is null or not regexp_full_match(id, '[0-9a-fA-F-]{36}') then 'id shape' end as reason from given",
        given=inputs.TEXT_IDS,
    ),
    "draft_ingest": """select case when p_partkey % 13 <> 0 then p_name end as title,
  case when p_partkey % 13 <> 0 and p_partkey % 5 = 1 then 'Mysuru' else 'Bengaluru' end as city,
  case when p_partkey % 13 <> 0 then cast(12.9 as double) end as latitude,
  case when p_partkey % 13 <> 0 and p_partkey % 3 in (0, 1) then 1 else 0 end as rooms,
  case when p_partkey % 13 <> 0 then case p_partkey % 3 when 0 then 30 when 1 then 15 end end as notice,
  case when p_partkey % 13 <> 0 and p_partkey % 4 = 0 then 2 else 0 end as amenities,
  case when p_partkey % 13 = 0 then 'malformed' when p_partkey % 7 = 0 then 'missing field'
    when p_partkey % 5 = 0 then 'null for a field with a default' end as reason from part""",
    "audit_keys": compose(
        _union(
            _duplicates("users", "id"), _duplicates("users", "firebase_uid"), _duplicates("users", "phone"),
            _duplicates("listings", "id"), _duplicates("room_options", "id"), _duplicates("amenities", "id"),
            _duplicates("amenities", "name"), _duplicates("listing_amenities", "listing_id", "amenity_id"),
            _duplicates("favorites", "user_id", "listing_id"), _duplicates("reviews", "id"),
            _duplicates("reviews", "listing_id", "user_id"), _duplicates("inquiries", "id"),
            _duplicates("inquiries", "tenant_id", "listing_id"),
        )
    ),
    "audit_orphans": compose(
        _union(
            _orphans("listings", "owner_id", "users"), _orphans("room_options", "listing_id", "listings"),
            _orphans("listing_amenities", "listing_id", "listings"), _orphans("listing_amenities", "amenity_id", "amenities"),
            _orphans("favorites", "user_id", "users"), _orphans("favorites", "listing_id", "listings"),
            _orphans("reviews", "listing_id", "listings"), _orphans("reviews", "user_id", "users"),
            _orphans("inquiries", "listing_id", "listings"), _orphans("inquiries", "tenant_id", "users"),
        )
    ),
    "audit_domains": compose(
        _union(
            _outside("users", "role", "'TENANT', 'OWNER'"),
            _outside("users", "gender", "'MALE', 'FEMALE', 'OTHER', 'PREFER_NOT_TO_SAY'"),
            _outside("listings", "gender_preference", "'MALE', 'FEMALE', 'COED'"),
            _outside("listings", "pg_type", "'PG', 'HOSTEL', 'COLIVING'"),
            _outside("listings", "food_type", "'VEG', 'NON_VEG', 'BOTH', 'NONE'"),
            _outside("listings", "status", "'ACTIVE', 'PAUSED', 'DELETED'"),
            _outside("room_options", "sharing_type", "'SINGLE', 'DOUBLE', 'TRIPLE', 'QUAD'"),
            _outside("reviews", "rating", "1, 2, 3, 4, 5"),
            _outside("inquiries", "status", "'PENDING', 'RESPONDED', 'CLOSED'"),
        )
    ),
    "audit_nulls": compose(
        _union(
            _nulls("users", "id", "firebase_uid", "phone", "role"),
            _nulls("listings", "id", "owner_id", "title", "address_line", "locality", "city", "lat", "lng"),
            _nulls("room_options", "id", "listing_id", "monthly_rent", "total_beds", "available_beds"),
            _nulls("favorites", "user_id", "listing_id"), _nulls("reviews", "id", "listing_id", "user_id", "rating"),
            _nulls("inquiries", "id", "listing_id", "tenant_id", "last_attempt_at"),
            _nulls("listing_amenities", "listing_id", "amenity_id"), _nulls("amenities", "id", "name"),
        )
    ),
    "cascade_plan": compose(
        """select distinct * from (
  select 'users' as table_name, cast(id as varchar) as row_key, 'delete' as action from users_v where id in (select id from du)
  union all select 'listings', cast(id as varchar), 'delete' from listings_v where id in (select id from dl)
  union all select 'room_options', cast(id as varchar), 'delete' from rooms_v where listing_id in (select id from dl)
  union all select 'listing_photos', cast(id as varchar), 'delete' from photos_v where listing_id in (select id from dl)
  union all select 'listing_amenities', concat(listing_id, '|', amenity_id), 'delete' from listing_amenities_v where listing_id in (select id from dl)
  union all select 'favorites', concat(user_id, '|', listing_id), 'delete' from favorites_v where listing_id in (select id from dl) or user_id in (select id from du)
  union all select 'reviews', cast(id as varchar), 'delete' from reviews_v where listing_id in (select id from dl)
  union all select 'reviews', cast(id as varchar), 'blocked' from reviews_v where user_id in (select id from du)
  union all select 'inquiries', concat(tenant_id, '|', listing_id), 'blocked' from inquiries_v where listing_id in (select id from dl) or tenant_id in (select id from du)
)""",
        du=inputs.DOOMED_USERS, dl0=inputs.DOOMED_LISTINGS,
        dl="select id from dl0 union select id from listings_v where owner_id in (select id from du)",
    ),
    "stream_inquiries": compose(INQUIRY_FOLD.format(extra="")),
    "stream_favorites": compose(FAVORITE_FOLD.format(order=ORDER)),
    "stream_reviews": REVIEW_FOLD,
    "stream_users": USER_FOLD.format(extra=""),
    "stream_ratings": compose(
        f"select t.listing_id, {rating('coalesce(s, 0)', 'coalesce(n, 0)')} as avg_rating, cast(coalesce(n, 0) as int) as review_count "
        "from (select distinct listing_id from review_events_v) t left join sums on sums.listing_id = t.listing_id",
        **REVIEWS, sums="select listing_id, sum(rating) as s, count(*) as n from state group by listing_id",
    ),
    "stream_inquiry_summary": compose(SUMMARY),
    "stream_favorites_compacted": compose(FAVORITE_FOLD.format(order=ORDER)),
    "event_source": "select event_type, count(*) as events from events group by event_type",
    "table_scan": compose(
        _union(*[
            f"select '{name}' as table_name, count(*) as rows from {view}"
            for name, view in (
                ("users", "users_v"), ("listings", "listings_v"), ("room_options", "rooms_v"),
                ("listing_amenities", "listing_amenities_v"), ("listing_photos", "photos_v"),
                ("favorites", "favorites_v"), ("reviews", "reviews_v"), ("inquiries", "inquiries_v"),
                ("amenities", "amenities_v"),
            )
        ])
    ),
    "document_roundtrip": compose(
        "select l.id, l.title, cast((select count(*) from rooms_v r where r.listing_id = l.id) as int) as rooms, "
        "cast((select count(*) from photos_v p where p.listing_id = l.id) as int) as photos, "
        "cast((select count(*) from listing_amenities_v a where a.listing_id = l.id) as int) as amenities "
        "from listings_v l join users_v u on u.id = l.owner_id where l.status <> 'DELETED'"
    ),
    "snapshot_roundtrip": compose(
        "select user_id, listing_id, epoch_us(created_at) as created_at from favorites_v"
    ),
    "listing_cells": compose(
        "select cast(floor(lat / 0.04) as int) as cell_lat, cast(floor(lng / 0.04) as int) as cell_lng, "
        "count(*) as listings from listings_v group by all"
    ),
    "search_envelope": compose(
        "select v.request_id, cast(count(p.listing_id) as int) as rows, v.page, v.n as size, "
        "cast((select count(*) from hits h where h.request_id = v.request_id) as int) as total, "
        "min_by(p.listing_id, p.position) as first_listing from valid v left join paged p on p.request_id = v.request_id "
        "group by v.request_id, v.page, v.n",
        **BATCH,
    ),
    "documents_for": compose(
        "select a.user_id, a.listing_id, f.user_id is not null as is_favorite, l.title, "
        "cast((select count(*) from rooms_v r where r.listing_id = l.id) as int) as rooms, "
        "cast((select count(*) from photos_v p where p.listing_id = l.id) as int) as photos, "
        "cast((select least(count(*), 5) from reviews_v r join users_v w on w.id = r.user_id "
        "where r.listing_id = l.id and r.is_flagged = false) as int) as reviews "
        "from asked a join listings_v l on l.id = a.listing_id join users_v u on u.id = l.owner_id "
        "left join favorites_v f on f.user_id = a.user_id and f.listing_id = a.listing_id where l.status <> 'DELETED'",
        asked="select user_id, listing_id from favorites_v union select user_id, listing_id + 1 from favorites_v",
    ),
    "backfill_reviews": compose(
        "select listing_id, user_id, rating, comment, epoch_us(created_at) as created_at from added", **BACKFILL
    ),
    "backfill_ratings": compose(
        f"select listing_id, {rating('sum(rating)', 'count(*)')} as avg_rating, cast(count(*) as int) as review_count from "
        "(select listing_id, rating from reviews_v union all select listing_id, rating from added) "
        "where listing_id in (select id from listings_v) group by listing_id",
        **BACKFILL,
    ),
    "generate_rooms": compose(
        f"""select id as listing_id, 'DOUBLE' as sharing_type, {_span(8000, 7000, 'double rent')} as monthly_rent,
  {_span(15000, 10000, 'double deposit')} as security_deposit, 4 as total_beds, {_span(1, 3, 'double free')} as available_beds,
  30 as notice_period_days from listings_v union all
select id, 'SINGLE', {_span(14000, 8000, 'single rent')}, {_span(25000, 15000, 'single deposit')}, 1, 1, 30
from listings_v where pg_type in ('COLIVING', 'PG')"""
    ),
    "generate_links": compose(
        f"""select l.id as listing_id, a.id as amenity_id from listings_v l, amenities_v a where a.name in ('WiFi', 'Power Backup')
union all select l.id, a.id from listings_v l, amenities_v a where a.name in ('AC', 'Laundry', 'CCTV', 'Hot Water')
  and {_draw('amenity', 'l.id', 'a.id')} > 0.4"""
    ),
}


def _antipodal() -> str:
    """Bisection for the azimuth as a recursive statement, one row per pair and step."""
    f, a = 1 / 298.257223563, 6378137.0
    b = a * (1 - f)
    path = (
        "select *, x2s as x2q from (select *, -sin({m}) * cb1 as x1, cos({m}) * cb1 as s0, "
        "sqrt(greatest(0, power(sin({m}) * cb1, 2) + (sb1 - sb2) * (sb1 + sb2))) as x2s from {t})"
    )
    arcs = (
        "select *, atan2(sb1, x1) as s1, atan2(sb2, x2q) as s2, atan2(s0 * sb2, x2q) - atan2(s0 * sb1, x1) as w, "
        f"greatest(0, 1 - s0 * s0) as c0, {f!r} / 16 * greatest(0, 1 - s0 * s0) * (4 + {f!r} * (4 - 3 * greatest(0, 1 - s0 * s0))) as k from ({{p}})"
    )
    gained = (
        f"w - (1 - k) * {f!r} * s0 * (s2 - s1 + k * sin(s2 - s1) * (cos(s1 + s2) + k * cos(s2 - s1) * (2 * power(cos(s1 + s2), 2) - 1)))"
    )
    step = arcs.format(p=path.format(m="((lo + hi) / 2)", t="solve where step < 64"))
    end = arcs.format(p=path.format(m="((lo + hi) / 2)", t="solve where step = 64"))
    return f"""with recursive pairs as ({inputs.ANTIPODAL_PAIRS}),
reduced as (select id, atan({1 - f!r} * tan(radians(req_lat))) as u1, atan({1 - f!r} * tan(radians(lat))) as u2,
  abs((radians(lng - req_lng) + pi()) - 2 * pi() * floor((radians(lng - req_lng) + pi()) / (2 * pi())) - pi()) as l from pairs),
turned as (select id, l, u1, u2, case when abs(u1) >= abs(u2) then u1 else u2 end as b1, case when abs(u1) >= abs(u2) then u2 else u1 end as b2 from reduced),
solve as (
  select id, l, least(-sin(abs(b1)), -1e-15) as sb1, cos(b1) as cb1, sin(case when b1 > 0 then -b2 else b2 end) as sb2,
    -pi() / 2 as lo, pi() / 2 as hi, 0 as step from turned
  union all
  select id, l, sb1, cb1, sb2, case when {gained} < l then (lo + hi) / 2 else lo end, case when {gained} < l then hi else (lo + hi) / 2 end,
    step + 1 from ({step})),
scaled as (select *, c0 * {(a * a - b * b) / (b * b)!r} as u, s2 - s1 as arc, cos(s1 + s2) as mid from ({end})),
series as (select *, 1 + u / 16384 * (4096 + u * (-768 + u * (320 - 175 * u))) as aa, u / 1024 * (256 + u * (-128 + u * (74 - 47 * u))) as bb from scaled),
metres as (select id, {b!r} * aa * (arc - bb * sin(arc) * (mid + bb / 4 * (cos(arc) * (2 * mid * mid - 1)
  - bb / 6 * mid * (4 * power(sin(arc), 2) - 3) * (4 * mid * mid - 3)))) as m from series)
select t.id, round(case when greatest(abs(t.u1), abs(t.u2)) <= 1e-7 and t.l <= {(1 - f)!r} * pi() then {a!r} * t.l else m end, 2) as metres
from metres join turned t on t.id = metres.id"""


ORACLE["geodesic_antipodal"] = _antipodal()
ORACLE["inquirer_estimates"] = compose(
    "select listing_id, count(distinct tenant_id) as exact, true as within from inquiries_v group by listing_id"
)
ORACLE["search_dense_total"] = ORACLE["search_batch_total"]
ORACLE["search_dense_page"] = ORACLE["search_batch_page"]
