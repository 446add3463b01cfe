"""Further registered queries: the archive's catalog, dictionaries, selections, colours, picking through a grid."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.fields import number
from ..operators import atoms as A
from ..operators import backbone as B
from ..operators import bonds as C
from ..operators import catalog, geometry, intervals, lookup, surface, tiles
from ..sources.store import kept, shared_folder
from ..sources.structures import fetch_structures, lines
from .queries import _BONDS, _ENDS, _POINTS, _RAYS, _SEGMENTS, _SPANS, _VOXELS, _balls, over, query, scene
from .scene import Scene, derived_lines


def _table(spark, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query("select p_partkey, case p_partkey % 10 when 0 then 12.5 when 1 then -300 when 2 then 31 when 5 then null when 6 then 0.5 when 7 then 5 when 8 then 8 else null end::double as value from part")
def number_fields(spark, sf_dir):
    """Numbers as fields hold them: decimals, exponents, hexadecimal, octal and binary forms, and what is none."""
    forms = ["12.5", " -3e2 ", "0x1F", "abc", "Infinity", "", "+.5", "0b101", "0o10", "1d"]
    text = F.element_at(F.array(*[F.lit(f) for f in forms]), (F.col("p_partkey") % 10 + 1).cast("int"))
    return _table(spark, sf_dir, "part").select("p_partkey", number(text).alias("value"))


@query("select c_custkey, (c_custkey * 7)::bigint as total from customer")
def count_entries(spark, sf_dir):
    """Totals of search answers in their three forms."""
    total = (F.col("c_custkey") * 7).cast("string")
    body = F.when(F.col("c_custkey") % 3 == 0, F.concat(F.lit('{"total_count":'), total, F.lit("}"))).when(F.col("c_custkey") % 3 == 1, F.concat(F.lit('{"total":'), total, F.lit(', "response": {"numFound": 1}}')))
    body = body.otherwise(F.concat(F.lit('{"response":{"numFound":'), total, F.lit("}}")))
    return catalog.with_totals(_table(spark, sf_dir, "customer").select("c_custkey", body.alias("body"))).select("c_custkey", "total")


def _pages(spark, sf_dir) -> DataFrame:
    """Search answers of 100 customers each; the list has two names, an id has three, page 7 is empty."""
    page = F.floor(F.col("c_custkey") / 100)
    name = F.element_at(F.array(F.lit("identifier"), F.lit("entry_id"), F.lit("id")), (F.col("c_custkey") % 3 + 1).cast("int"))
    item = F.concat(F.lit('{"'), name, F.lit('":"'), F.col("c_name"), F.lit('"}'))
    rows = _table(spark, sf_dir, "customer").select(page.alias("page"), "c_custkey", item.alias("item"))
    items = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("c_custkey", "item"))), lambda x: x["item"]), ",")
    key = F.when(F.col("page") % 2 == 0, F.lit("result_set")).otherwise(F.lit("resultSet"))
    return rows.groupBy("page").agg(items.alias("items")).select("page", F.concat(F.lit('{"'), key, F.lit('":['), F.when(F.col("page") == 7, "").otherwise(F.col("items")), F.lit("]}")).alias("body"))


_PAGES = "select c_custkey // 100 as page, row_number() over (partition by c_custkey // 100 order by c_custkey) - 1 as ord, c_name as entry_id from customer where c_custkey // 100 <> 7"


@query(f"select page::bigint as page, ord::int as ord, entry_id from ({_PAGES})")
def page_ids(spark, sf_dir):
    return catalog.page_ids(_pages(spark, sf_dir))


@query(f"select page::bigint as page, ord::int as ord, entry_id from ({_PAGES}) where page < 7")
def pages_up_to_empty(spark, sf_dir):
    return catalog.up_to_empty(_pages(spark, sf_dir))


@query("select (i * 700)::bigint as start, least(700, n - i * 700)::bigint as rows from (select n, unnest(range(0, (n + 699) // 700)) as i from (select count(*) as n from orders))")
def page_plan(spark, sf_dir):
    return catalog.page_plan(_table(spark, sf_dir, "orders").agg(F.count("*").alias("total")), 700)


@query("select p_partkey as entry_id, p_retailprice as score, row_number() over (order by p_retailprice desc, p_partkey) - 1 as rank from part")
def score_order(spark, sf_dir):
    return catalog.by_score(_table(spark, sf_dir, "part").select(F.col("p_partkey").alias("entry_id"), F.col("p_retailprice").alias("score")))


@query("select p_brand as source, string_agg(p_name, ',' order by p_partkey) as text from part group by 1")
def ids_joined(spark, sf_dir):
    return catalog.join_ids(_table(spark, sf_dir, "part").select(F.col("p_brand").alias("source"), F.col("p_partkey").alias("ord"), F.col("p_name").alias("entry_id")))


_PLAN = "select c_custkey as ord, trim(c_name) as entry_id from customer where c_custkey % 11 <> 0"


def _plan(spark, sf_dir) -> DataFrame:
    entry = F.when(F.col("c_custkey") % 11 == 0, F.lit("  ")).otherwise(F.concat(F.lit(" "), "c_name", F.lit(" ")))
    ids = _table(spark, sf_dir, "customer").select(F.col("c_custkey").cast("long").alias("ord"), entry.alias("entry_id"))
    return catalog.download_plan(ids, "https://files.example.org/download/", "entries", "CIF")


@query(f"select ord::bigint as ord, entry_id, 'https://files.example.org/download/' || entry_id || '.cif' as url, 'entries/' || entry_id || '.cif' as target from ({_PLAN})")
def download_plan(spark, sf_dir):
    return _plan(spark, sf_dir)


@query("""select event_id, round(case when status = 404 then null when status = 429 and later in ('3', '99') then least(15, later::double) else least(15, 0.5 * pow(2, attempt)) end, 6)::double as delay
    from (select event_id, event_id % 8 as attempt, [null, 429, 500, 503, 404][event_id % 5 + 1] as status, [null, '3', 'soon', '99'][event_id % 4 + 1] as later from events)""")
def retry_delays(spark, sf_dir):
    pick = lambda values, n: F.element_at(F.array(*[F.lit(v) for v in values]), (F.col("event_id") % n + 1).cast("int"))
    rows = _table(spark, sf_dir, "events").select("event_id", (F.col("event_id") % 8).alias("attempt"), pick([None, 429, 500, 503, 404], 5).alias("status"), pick([None, "3", "soon", "99"], 4).alias("retry_after"))
    return catalog.retry_delays(rows).select("event_id", F.round("delay", 6).alias("delay"))


def _fetch(url: str) -> tuple[int, bytes, str | None]:
    """Stands in for the archive: the id's last two digits decide the answer."""
    n = int(url.rsplit("/", 1)[1].split(".")[0][-2:])
    if n % 10 == 3:
        raise ConnectionError("no answer")
    return (404, b"", None) if n % 10 == 4 else (429, b"", "1") if n % 10 == 5 else (503, b"", None) if n % 10 == 6 else (200, b"x" * n, None)


def _events(spark, sf_dir) -> DataFrame:
    plan = _plan(spark, sf_dir)
    done = plan.filter("ord % 4 = 0").select("target", F.when(F.col("ord") % 8 == 0, 10).otherwise(0).alias("size_bytes"))
    return catalog.download(plan, _fetch, lambda target, body: None, done, retries=2, wait=lambda seconds: None)


_DONE = f"""select *, case when ord % 8 = 0 then 'download_skip' when n % 10 between 3 and 6 then 'download_error' else 'download_ok' end as event from (select *, right(entry_id, 2)::int as n from ({_PLAN}))"""
_EVENTS = f"""select ord::bigint as ord, entry_id as id, event, case when event = 'download_ok' then n::bigint end as size_bytes,
    case when event <> 'download_skip' then case n % 10 when 3 then null when 4 then 404 when 5 then 429 when 6 then 503 else 200 end end::int as status,
    case event when 'download_skip' then 'exists' when 'download_error' then ['ConnectionError', 'client_error', 'rate_limited', 'server_error'][n % 10 - 2] end as reason,
    case when event <> 'download_skip' then case when n % 10 in (3, 5, 6) then 3 else 1 end end::int as attempts from ({_DONE})"""


@query(_EVENTS)
def download_events(spark, sf_dir):
    return _events(spark, sf_dir).select("ord", "id", "event", "size_bytes", "status", "reason", "attempts")


@query(f"select ord::bigint as ord, 'entries/' || entry_id || '.cif' as path from ({_DONE}) where event <> 'download_error'")
def download_paths(spark, sf_dir):
    return catalog.fetched_paths(_events(spark, sf_dir))


@query(f"select event, reason, (2 * count(*))::bigint as n from ({_EVENTS}) group by 1, 2")
def event_log(spark, sf_dir):
    """Events appended twice to a log of JSON lines and read back."""
    path = f"{shared_folder(spark)}/strandloom/events-{uuid.uuid4().hex}"
    events = kept(_events(spark, sf_dir), "events")
    for _ in range(2):
        catalog.write_events(events, path)
    return catalog.read_events(spark, path).groupBy("event", "reason").agg(F.count("*").alias("n"))


_ORDER = "md5('{seed}:' || {id})"


@query(f"select o_orderkey as entry_id from orders qualify row_number() over (order by {_ORDER.format(seed=42, id='o_orderkey')}, o_orderkey) <= (select greatest(1, count(*) * 10 // 100) from orders)")
def sample_hash_k(spark, sf_dir):
    return catalog.sample(_table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("entry_id")), 10, seed=42)


@query(f"""select entry_id from (select c_custkey as entry_id, {_ORDER.format(seed=7, id='c_custkey')} as h from customer where c_custkey % 3 <> 0) order by h, entry_id limit 60""")
def fetch_exactly(spark, sf_dir):
    """Attempts, in the order of a seed, until 60 entries are fetched; a third of all fail and are topped up."""
    universe = _table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("entry_id"))
    event = F.when(F.col("entry_id") % 3 != 0, "download_ok").otherwise("download_error")
    events = catalog.fetch_exactly(universe, 60, lambda ids: kept(ids.select(F.col("entry_id").alias("id"), event.alias("event")), "attempt"), seed=7)
    return events.filter("event = 'download_ok'").select(F.col("id").alias("entry_id"))


@query("select 'data:text/plain,' || 'ATOM%20%20' || lpad(p_partkey::varchar, 5, '0') as structure_id, p_partkey as serial, (p_size + 0.5)::double as x, 'GLY' as res_name from part where p_partkey <= 99999 and p_partkey % 5 <> 0")
def fetched_structures(spark, sf_dir):
    """Structures fetched by URL and parsed; every other one only by the fallback, each fifth by neither."""
    part = _table(spark, sf_dir, "part").filter("p_partkey <= 99999")
    serial = F.lpad(F.col("p_partkey").cast("string"), 5, "0")
    rest = F.concat(F.lit("%20%20CA%20%20GLY%20A%20%20%201%20%20%20%20"), F.lpad(F.concat(F.col("p_size").cast("string"), F.lit(".500")), 8, "0"), F.lit("%20%20%201.000%20%20%202.000"))
    head = F.concat(F.lit("data:text/plain,ATOM%20%20"), serial)
    urls = part.select(F.when(F.col("p_partkey") % 5 == 0, F.lit("nowhere:")).when(F.col("p_partkey") % 2 == 0, F.concat(F.lit("again:"), head, rest)).otherwise(F.concat(head, rest)).alias("url"))
    from ..sources.structures import open_url

    texts = fetch_structures(urls, fallback=lambda url: open_url(url.removeprefix("again:")))
    s = Scene(lines(texts.filter("text is not null").select("structure_id", "text")))
    name = F.substring(F.regexp_replace("structure_id", "^again:", ""), 1, 31)
    return s.raw.select(name.alias("structure_id"), F.col("serial").cast("long").alias("serial"), "x", "res_name")


@query("select structure_id, warning from (select l_suppkey as structure_id, 'Line ' || l_orderkey || '.' || l_linenumber || ': missing coordinates, atom skipped' as warning from lineitem) qualify row_number() over (partition by structure_id order by warning) <= 20")
def warning_cap(spark, sf_dir):
    """Warnings of each structure, a fixed number at most, as one list and taken apart again."""
    text = F.format_string("Line %s.%s: missing coordinates, atom skipped", F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string"))
    rows = _table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("structure_id"), text.alias("warning"))
    return catalog.warning_lists(rows, 20).select("structure_id", F.explode("warnings").alias("warning"))


@query(over() + "select structure_id, max(atom_idx) + 1 as atoms, max(residue_idx) + 1 as residues, max(chain_idx) + 1 as chains from f group by 1")
def table_sizes(spark, sf_dir):
    return lookup.table_sizes(scene(spark, sf_dir).atoms)


@query(over() + "select structure_id, chain_id as key, max(chain_idx) as chain_idx from c group by 1, 2")
def chain_keys(spark, sf_dir):
    return lookup.chain_keys(scene(spark, sf_dir).chains)


@query(over() + "select structure_id, chain_id || '|' || res_seq || '||' || res_name as key, residue_idx from r")
def residue_keys(spark, sf_dir):
    s = scene(spark, sf_dir)
    return lookup.residue_keys(s.atoms, s.chains, s.residues)


@query(over() + "select structure_id, array_to_string(list_sort(coalesce(list(chain_idx) filter (where chain_id <> 'N'), [])), ',') as chains from c group by 1")
def visible_chains(spark, sf_dir):
    visible = F.when(F.col("chain_id") == "N", False).when(F.col("chain_id") == "A", True)
    shown = lookup.visible_chains(scene(spark, sf_dir).chains.withColumn("visible", visible))
    return shown.withColumn("chains", F.array_join(F.transform("chains", lambda c: c.cast("string")), ","))


@query(over() + "select structure_id, atom_idx, 'residue' as mode, residue_idx as id from f where atom_idx % 7 = 0 union all select structure_id, atom_idx, 'chain', chain_idx from f where atom_idx % 7 = 0 union all select structure_id, atom_idx, 'atom', atom_idx from f where atom_idx % 7 = 0 union all select structure_id, atom_idx + 10000000, unnest(['residue', 'chain', 'atom']), null from f where atom_idx % 7 = 0")
def hovered_ids(spark, sf_dir):
    atoms = scene(spark, sf_dir).atoms
    # numbers past the last atom are picks of nothing and give null
    picks = atoms.filter("atom_idx % 7 = 0").select("structure_id", F.explode(F.array(F.col("atom_idx"), F.col("atom_idx") + 10_000_000)).alias("atom_idx"))
    each = [lookup.hovered(atoms, picks, mode).select("structure_id", "atom_idx", F.lit(mode).alias("mode"), "id") for mode in ("atom", "residue", "chain")]
    return each[0].unionByName(each[1]).unionByName(each[2])


@query(over(_ENDS) + """select 'atom' as kind, structure_id, atom_idx as a, null::int as b from f where residue_idx in (1, 4)
    union all select 'bond', structure_id, a, b from ends where residue_idx_a in (1, 4) or residue_idx_b in (1, 4)""")
def hover_overlay(spark, sf_dir):
    s = scene(spark, sf_dir)
    hover = s.residues.filter("residue_idx in (1, 4)").select("structure_id", F.col("residue_idx").alias("id"))
    atoms, bonds = lookup.overlay(s.atoms, s.ends("residue_idx"), hover, "residue")
    lit = atoms.select(F.lit("atom").alias("kind"), "structure_id", F.col("atom_idx").alias("a"), F.lit(None).cast("int").alias("b"))
    return lit.unionByName(bonds.select(F.lit("bond").alias("kind"), "structure_id", "a", "b"))


_RGB = "[[144, 144, 144], [48, 80, 248], [255, 13, 13], [255, 255, 48], [255, 255, 255], [61, 255, 0], [143, 64, 212]]"


@query(over() + f"select structure_id, atom_idx, x, y, z, round(vdw * 0.5, 6)::double as scale, round({_RGB}[ln][1] / 255, 6)::double as red, round({_RGB}[ln][2] / 255, 6)::double as green, round({_RGB}[ln][3] / 255, 6)::double as blue from f")
def atom_spheres(spark, sf_dir):
    s = geometry.atom_spheres(scene(spark, sf_dir).atoms, 0.5)
    return s.select("structure_id", "atom_idx", "x", "y", "z", F.round("scale", 6).alias("scale"), *[F.round(F.col("colour")[n], 6).alias(c) for n, c in enumerate(("red", "green", "blue"))])


@query(over(_ENDS) + " union all ".join(f"select structure_id, a, b, {v} as vertex, round({_RGB}[ln_{e}][1] / 255, 6)::double as red, round({_RGB}[ln_{e}][2] / 255, 6)::double as green, round({_RGB}[ln_{e}][3] / 255, 6)::double as blue from ends" for v, e in enumerate("ab")))
def bond_line_colours(spark, sf_dir):
    s = scene(spark, sf_dir)
    return geometry.bond_lines(s.ends(*geometry.ENDS)).select("structure_id", "a", "b", "vertex", *[F.round(F.col("colour")[n], 6).alias(c) for n, c in enumerate(("red", "green", "blue"))])


@query(over(_ENDS) + """, e as (
        select structure_id, a, b, x_b - x_a as dx, y_b - y_a as dy, z_b - z_a as dz from ends
    ), u as (select *, sqrt(dx * dx + dy * dy + dz * dz) as n from e), w as (select *, dx / n as ux, dy / n as uy, dz / n as uz from u where n > 1e-6)
    select structure_id, a, b, round(case when n <= 1e-6 then 0 when uy < -1 + 1e-15 then 0 else uz / sqrt(ux * ux + uz * uz + (1 + uy) * (1 + uy)) end, 6) + 0.0 as qx,
        round(case when n <= 1e-6 then 0 when uy < -1 + 1e-15 then 1 else -ux / sqrt(ux * ux + uz * uz + (1 + uy) * (1 + uy)) end, 6) + 0.0 as qz,
        round(case when n <= 1e-6 then 1 when uy < -1 + 1e-15 then 0 else (1 + uy) / sqrt(ux * ux + uz * uz + (1 + uy) * (1 + uy)) end, 6) + 0.0 as qw from w""")
def bond_rotations(spark, sf_dir):
    """Quaternions that turn the y axis to each bond (no derived bond is shorter than its least distance)."""
    s = scene(spark, sf_dir)
    return geometry.bond_tubes(s.ends(*geometry.ENDS)).filter("length > 0").select("structure_id", "a", "b", *[(F.round(c, 6) + 0.0).alias(c) for c in ("qx", "qz", "qw")])


@query(over() + "select structure_id, chain_idx, min(residue_idx) as start_residue, max(residue_idx) as end_residue from f group by 1, 2")
def fallback_segments(spark, sf_dir):
    """Segments of structures without any TER record: whole chains."""
    s = Scene(derived_lines(spark, sf_dir).filter("line not like 'TER%'"))
    return B.fallback_segments(s.atoms, s.segments).select("structure_id", "chain_idx", "start_residue", "end_residue")


@query(over(_SEGMENTS) + "select structure_id, chain_idx, start_residue, end_residue from g")
def ter_of_blank_chain(spark, sf_dir):
    """TER records without chain close the chain of the last atom before them."""
    blank = F.when(F.col("line").startswith("TER"), F.lit("TER   ")).otherwise(F.col("line"))
    return Scene(derived_lines(spark, sf_dir).withColumn("line", blank)).segments.drop("ter_line")


@query(over(_BONDS, _POINTS) + "select 'atoms' as layer, count(*) as n from f union all select 'lines', 2 * count(*) from bonds union all select 'backbone', count(*) from (select lead(point) over (partition by structure_id, segment order by point) as q from p) where q is not null")
def scene_layers(spark, sf_dir):
    """Rows of the layers of a drawable scene; layers that are not asked for are not made."""
    s = scene(spark, sf_dir)
    layers = geometry.scene(s.atoms, s.ends(*geometry.ENDS), s.points, None, ("atoms", "lines", "backbone"))
    each = [df.agg(F.count("*").alias("n")).select(F.lit(k).alias("layer"), "n") for k, df in layers.items()]
    return each[0].unionByName(each[1]).unionByName(each[2])


_CELLS = """, net as (
    select structure_id, i - p.d as i, j - q.d as j, k - w.d as k, list(p.d + 2 * q.d + 4 * w.d) as m from vox, o p, o q, o w where p.d in (0, 1) and q.d in (0, 1) and w.d in (0, 1) group by all having count(*) < 8
)"""


@query(over(_VOXELS, _CELLS) + """, corner as (
        select * from (values ('xz', 0, 0, 0), ('xz', 1, 0, 0), ('xz', 1, 0, 1), ('xz', 0, 0, 1), ('yz', 0, 0, 0), ('yz', 0, 1, 0), ('yz', 0, 1, 1), ('yz', 0, 0, 1), ('xy', 0, 0, 0), ('xy', 1, 0, 0), ('xy', 1, 1, 0), ('xy', 0, 1, 0)) v(plane, a, b, c)
    )
    select structure_id, plane, qi, qj, qk from (select structure_id, plane, (i + a)::int as qi, (j + b)::int as qj, (k + c)::int as qk from net, corner)
    group by all having count(*) = 4 and (plane <> 'xy' or qk > 0)""")
def surface_net_quads(spark, sf_dir):
    return tiles.quads(_balls(spark, sf_dir)[0]).select("structure_id", "plane", "qi", "qj", "qk")


@query(over(_VOXELS, _CELLS) + """, e as (select unnest([(0, 1), (2, 3), (4, 5), (6, 7), (0, 2), (1, 3), (4, 6), (5, 7), (0, 4), (1, 5), (2, 6), (3, 7)]) as e),
        mid as (select structure_id, i, j, k, e[1] as u, e[2] as v from net, e where list_contains(m, e[1]) <> list_contains(m, e[2])),
        vert as (select structure_id, i, j, k, i + avg((u % 2 + v % 2) / 2) as x, j + avg(((u // 2) % 2 + (v // 2) % 2) / 2) as y, k + avg((u // 4 + v // 4) / 2) as z from mid group by structure_id, i, j, k)
    , met as (
        select structure_id, floor(x + 0.5)::int as vi, floor(y + 0.5)::int as vj, floor(z + 0.5)::int as vk, i, j, k, null::bigint as best from vert union all select structure_id, i, j, k, null, null, null, best::bigint from vox
    ), owned as (select *, max(best) over (partition by structure_id, vi, vj, vk) as owner from met)
    select structure_id, i::int as i, j::int as j, k::int as k, coalesce(owner % 1000000, 0)::bigint as atom_idx from owned where i is not null""")
def surface_vertex_owners(spark, sf_dir):
    return tiles.vertices(_balls(spark, sf_dir)[0]).select("structure_id", "i", "j", "k", surface.first_if_outside())


@query(over() + ", rays as (select * from (values " + ", ".join(f"({r[0]}, " + ", ".join(f"{v}::double" for v in r[1:]) + ")" for r in _RAYS) + """) v(ray, ox, oy, oz, dx, dy, dz)), box as (
        select structure_id, min(x)::double as lx, max(x)::double as hx, min(y)::double as ly, max(y)::double as hy, min(z)::double as lz, max(z)::double as hz from a group by 1
    ), gc as (select structure_id, greatest(1e-4, avg(vdw) * 2.0) as cell from f group by 1), r1 as (
        select structure_id, ray, ox, oy, oz, dx, dy, dz, lx, ly, lz, cell,
            greatest(0, case when dx <> 0 then least((lx - ox) / dx, (hx - ox) / dx) else -1e300 end, case when dy <> 0 then least((ly - oy) / dy, (hy - oy) / dy) else -1e300 end, case when dz <> 0 then least((lz - oz) / dz, (hz - oz) / dz) else -1e300 end) as t0,
            least(case when dx <> 0 then greatest((lx - ox) / dx, (hx - ox) / dx) else 1e300 end, case when dy <> 0 then greatest((ly - oy) / dy, (hy - oy) / dy) else 1e300 end, case when dz <> 0 then greatest((lz - oz) / dz, (hz - oz) / dz) else 1e300 end) as t1
        from rays, box join gc using (structure_id) where (dx <> 0 or ox between lx and hx) and (dy <> 0 or oy between ly and hy) and (dz <> 0 or oz between lz and hz)
    ), r2 as (select * from r1 where t0 <= t1), ax as (
        select structure_id, ray, t0, t1, cell, 0 as axis, dx as d, ox + dx * t0 - lx as s from r2 union all select structure_id, ray, t0, t1, cell, 1, dy, oy + dy * t0 - ly from r2 union all select structure_id, ray, t0, t1, cell, 2, dz, oz + dz * t0 - lz from r2
    ), ax2 as (select *, floor(s / cell)::bigint as i0 from ax), ax3 as (select *, ((i0 + case when d > 0 then 1 else 0 end) * cell - s) / d as f1, cell / abs(d) as step from ax2 where d <> 0),
    cr as (select structure_id, ray, axis, t0 + f1 + n * step as t from (select *, unnest(range(0, greatest(0, floor((t1 - t0 - f1) / step)::bigint + 1))) as n from ax3)),
    ev as (select structure_id, ray, -1 as axis, t0 as t from r2 union all select structure_id, ray, axis, t from cr),
    cel as (
        select ev.structure_id, ray, row_number() over w as place, lead(t, 1, 1e300) over w as exit, sum((axis = 0)::int) over w as nx, sum((axis = 1)::int) over w as ny, sum((axis = 2)::int) over w as nz from ev window w as (partition by ev.structure_id, ray order by t, axis rows between unbounded preceding and current row)
    ), way as (
        select cel.structure_id, cel.ray, place, exit, r2.ox, r2.oy, r2.oz, r2.dx, r2.dy, r2.dz, r2.t0, r2.t1, (x.i0 + nx * sign(r2.dx))::bigint as cx, (y.i0 + ny * sign(r2.dy))::bigint as cy, (z.i0 + nz * sign(r2.dz))::bigint as cz
        from cel join r2 using (structure_id, ray) join ax2 x on x.structure_id = cel.structure_id and x.ray = cel.ray and x.axis = 0 join ax2 y on y.structure_id = cel.structure_id and y.ray = cel.ray and y.axis = 1 join ax2 z on z.structure_id = cel.structure_id and z.ray = cel.ray and z.axis = 2
    ), fa as (select structure_id, atom_idx, f.x::double as x, f.y::double as y, f.z::double as z, vdw, floor((f.x - lx) / cell)::bigint as cx, floor((f.y - ly) / cell)::bigint as cy, floor((f.z - lz) / cell)::bigint as cz from f join box using (structure_id) join gc using (structure_id)),
    m as (select way.structure_id, ray, place, exit, t0, t1, atom_idx, (ox - x) * dx + (oy - y) * dy + (oz - z) * dz as b, (ox - x) * (ox - x) + (oy - y) * (oy - y) + (oz - z) * (oz - z) - vdw * vdw as q from way join fa on fa.structure_id = way.structure_id and fa.cx = way.cx and fa.cy = way.cy and fa.cz = way.cz),
    h as (select structure_id, ray, place, atom_idx, -b - sqrt(b * b - q) as t from m where b * b - q >= 0 and -b - sqrt(b * b - q) between t0 and t1),
    best as (select way.structure_id, way.ray, way.place, way.exit, min(h.t) as t, arg_min(h.atom_idx, (h.t, h.atom_idx)) as atom_idx from way left join h on h.structure_id = way.structure_id and h.ray = way.ray and h.place = way.place group by all),
    run as (select structure_id, ray, place, exit, min((coalesce(t, 1e301), coalesce(atom_idx, -1))) over (partition by structure_id, ray order by place rows between unbounded preceding and current row) as s from best)
    select structure_id, ray, arg_min(s[2], place)::int as atom_idx, round(arg_min(s[1], place), 6) as t from run where s[1] < exit and s[1] < 1e300 group by 1, 2""")
def ray_grid_hit(spark, sf_dir):
    s = scene(spark, sf_dir)
    rays = spark.createDataFrame(_RAYS, "ray int, ox double, oy double, oz double, dx double, dy double, dz double")
    each = s.chains.select("structure_id").distinct().join(F.broadcast(rays))  # a fixed set of three rays for each structure
    return lookup.grid_ray_hits(s.atoms, A.bounding_boxes(s.raw), each).withColumn("t", F.round("t", 6))


@query(over(_BONDS) + "select structure_id, 'Heuristic bonds: created ' || count(*) || ' total bonds' as warning from bonds group by 1")
def bond_warnings(spark, sf_dir):
    return C.bond_warnings(scene(spark, sf_dir).bonds)


_SAS = """, box as (
        select structure_id, floor(min(x - (vdw + 1.4)) - (5.5 + 1.4)) as lx, floor(min(y - (vdw + 1.4)) - (5.5 + 1.4)) as ly, floor(min(z - (vdw + 1.4)) - (5.5 + 1.4)) as lz from f group by 1
    ), ball as (
        select structure_id, atom_idx, floor(x - lx + 0.5)::int as ci, floor(y - ly + 0.5)::int as cj, floor(z - lz + 0.5)::int as ck, first(vdw + 1.4 + 0.5) over (partition by structure_id, floor(vdw + 1.4 + 0.5 + 0.5) order by atom_idx) as rad from f join box using (structure_id)
    ), line as (select unnest(range(-5, 6))::int as d), o as (select unnest(range(0, 2))::int as d), oo as materialized (select p.d as di, q.d as dj, w.d as dk, p.d * p.d + q.d * q.d + w.d * w.d as d2 from line p, line q, line w),
    vox as materialized (select structure_id, ci + di as i, cj + dj as j, ck + dk as k, min(d2::bigint * 1000000 + atom_idx) as best from ball join oo on d2 <= rad * rad group by all)"""
#: On a grid of 1 the cut-off of a probe of 1.4 lies between 1 and 2 voxels: what stays are voxels that are no boundary (all 27 around
#: them are full) and do not touch one by a face.
_SES = _SAS + """, inner_x as (select * from vox qualify count(*) over (partition by structure_id, j, k order by i range between 1 preceding and 1 following) = 3),
    inner_y as (select * from inner_x qualify count(*) over (partition by structure_id, i, k order by j range between 1 preceding and 1 following) = 3),
    inner_z as (select * from inner_y qualify count(*) over (partition by structure_id, i, j order by k range between 1 preceding and 1 following) = 3),
    solid as materialized (select * from inner_z qualify count(*) over (partition by structure_id, j, k order by i range between 1 preceding and 1 following) = 3
        and count(*) over (partition by structure_id, i, k order by j range between 1 preceding and 1 following) = 3 and count(*) over (partition by structure_id, i, j order by k range between 1 preceding and 1 following) = 3)"""
_EDGES = "e as (select unnest([(0, 1), (2, 3), (4, 5), (6, 7), (0, 2), (1, 3), (4, 6), (5, 7), (0, 4), (1, 5), (2, 6), (3, 7)]) as e)"
_VERTICES = _EDGES + """, mid as (select structure_id, i, j, k, e[1] as u, e[2] as v from net, e where list_contains(m, e[1]) <> list_contains(m, e[2])),
    vert as materialized (select structure_id, i, j, k, i + avg((u % 2 + v % 2) / 2) as x, j + avg(((u // 2) % 2 + (v // 2) % 2) / 2) as y, k + avg((u // 4 + v // 4) / 2) as z from mid group by structure_id, i, j, k)"""


@query(over(_SAS) + "select structure_id, i, j, k, (best % 1000000)::int as atom_idx, (best // 1000000)::int as d2 from vox")
def sas_fill_owner(spark, sf_dir):
    """Voxels of the solvent-accessible solid with their owners."""
    return tiles.voxels(_balls(spark, sf_dir, "sas")[0])


@query(over(_SES) + "select structure_id, i, j, k, (best % 1000000)::int as atom_idx, (best // 1000000)::int as d2 from solid")
def ses_solid_voxels(spark, sf_dir):
    """Voxels that stay when the probe is rolled off the solvent-accessible solid, with their owners."""
    atoms = surface.surface_input(scene(spark, sf_dir).atoms)
    return surface.ses_voxels(atoms, surface.grids(atoms, "ses", voxel=1.0))


@query(over(_SES, _CELLS.replace("from vox,", "from solid,")) + ", " + _VERTICES + """, met as (
        select structure_id, floor(x + 0.5)::int as vi, floor(y + 0.5)::int as vj, floor(z + 0.5)::int as vk, i, j, k, x, y, z, null::bigint as best from vert union all select structure_id, i, j, k, null, null, null, null, null, null, best::bigint from vox
    ), owned as (select *, max(best) over (partition by structure_id, vi, vj, vk) as owner from met)
    select structure_id, i::int as i, j::int as j, k::int as k, round((x + lx)::float::double, 4) as x, round((y + ly)::float::double, 4) as y, round((z + lz)::float::double, 4) as z, coalesce(owner % 1000000, 4294967295)::bigint as atom_idx
    from owned join box using (structure_id) where i is not null""")
def ses_surface(spark, sf_dir):
    """Vertices of the solvent-excluded surface in structure coordinates, with the atoms that own them."""
    vertices, _ = surface.surface(scene(spark, sf_dir).atoms, "ses", voxel=1.0)
    return vertices.select("structure_id", "i", "j", "k", *[F.round(F.col(c).cast("double"), 4).alias(c) for c in "xyz"], "atom_idx")


@query(over(_VOXELS, _CELLS) + ", " + _VERTICES + """, corner as (
        select * from (values ('xz', 0, 0, 0, 0), ('xz', 1, 1, 0, 0), ('xz', 2, 1, 0, 1), ('xz', 3, 0, 0, 1), ('yz', 0, 0, 0, 0), ('yz', 1, 0, 1, 0), ('yz', 2, 0, 1, 1), ('yz', 3, 0, 0, 1), ('xy', 0, 0, 0, 0), ('xy', 1, 1, 0, 0), ('xy', 2, 1, 1, 0), ('xy', 3, 0, 1, 0)) v(plane, n, a, b, c)
    ), quad as (
        select structure_id, plane, (i + a)::int as qi, (j + b)::int as qj, (k + c)::int as qk, list([x, y, z] order by n) as v from vert, corner group by 1, 2, 3, 4, 5 having count(*) = 4 and (plane <> 'xy' or qk > 0)
    ), half as (
        select structure_id, plane, qi, qj, qk, h as half, list_transform(range(1, 4), lambda c: v[2 + h][c] - v[1][c]) as d, list_transform(range(1, 4), lambda c: v[3 + h][c] - v[1][c]) as g from (select *, unnest([0, 1]) as h from quad)
    ), size as (select *, (d[2] * g[3] - d[3] * g[2]) ** 2 + (d[3] * g[1] - d[1] * g[3]) ** 2 + (d[1] * g[2] - d[2] * g[1]) ** 2 as n2 from half)
    select structure_id, plane, qi, qj, qk, half, round(sqrt(n2) / 2, 4) as area from size where n2 > 1e-10""")
def vdw_surface(spark, sf_dir):
    """Triangles of the van der Waals surface with their areas, two a quad but for degenerate ones."""
    return surface.areas(scene(spark, sf_dir).atoms, "vdw", voxel=1.0).withColumn("area", F.round("area", 4))


def _grid_sql(kind: str, inflate: float, stretch: int) -> str:
    r = f"(vdw + {inflate})"
    ends = ", ".join(f"min({c} * {stretch} - {r}) as lo_{c}, max({c} * {stretch} + {r}) as hi_{c}" for c in "xyz")
    sizes = ", ".join(f"(ceil(scale * ((ceil((hi_{c} + pad) * scale) / scale) - (floor((lo_{c} - pad) * scale) / scale))) + 1)::int as n{c}" for c in "xyz")
    return f"""select structure_id, '{kind}' as kind, {stretch} as stretch, scale, {sizes} from (
        select *, 5.5 / scale + {inflate} as pad from (select *, case when (hi_x - lo_x) * (hi_y - lo_y) * (hi_z - lo_z) > 1000000 then 1.0 else 2.0 end::double as scale from (select structure_id, {ends} from f group by 1)))"""


@query(over() + " union all ".join(_grid_sql(k, r, t) for k, r in (("vdw", 0.0), ("sas", 1.4)) for t in (1, 40)))
def surface_grids(spark, sf_dir):
    """Grids at the default scale, and of structures stretched until their volume takes half that scale."""
    atoms = surface.surface_input(scene(spark, sf_dir).atoms)
    each = []
    for kind in ("vdw", "sas"):
        for stretch in (1, 40):
            far = atoms.select("structure_id", "atom_idx", *[(F.col(c) * stretch).alias(c) for c in "xyz"], "radius")
            each.append(surface.grids(far, kind).select("structure_id", F.lit(kind).alias("kind"), F.lit(stretch).alias("stretch"), "scale", "nx", "ny", "nz"))
    return each[0].unionByName(each[1]).unionByName(each[2]).unionByName(each[3])


@query()
def ribbon_flat(spark, sf_dir):
    """Corners of the flat ribbons; tests hold them against frames turned one by one."""
    s = scene(spark, sf_dir)
    return geometry.flat_ribbons(s.points, s.atoms, B.residue_kinds(s.spans))


@query(over(_POINTS) + ", z as (select structure_id, segment, greatest(8, 4 * count(*)) as last from p where size >= 2 group by 1, 2) select structure_id, segment, unnest(range(0, last))::int as sample, 16 as faces from z")
def ribbon_tube(spark, sf_dir):
    """Triangles between the rings of the tube along each backbone segment, counted by sample; rings have eight corners."""
    s = scene(spark, sf_dir)
    corners = geometry.tube_ribbons(s.points, s.atoms, B.residue_kinds(s.spans))
    return geometry.ribbon_faces(corners, 8).groupBy("structure_id", "segment", "sample").agg(F.count("*").cast("int").alias("faces"))


@query("select trim(t) as entry_id, count(*) as n from (select unnest(string_split(p_name, ',')) as t from part) where trim(t) <> '' group by 1")
def ids_written(spark, sf_dir):
    """Ids through id files: written in lines of one brand each, read back and split."""
    part = _table(spark, sf_dir, "part").select(F.col("p_brand").alias("source"), F.col("p_partkey").alias("ord"), F.col("p_name").alias("entry_id"))
    path = f"{shared_folder(spark)}/strandloom/ids-{uuid.uuid4().hex}"
    catalog.write_ids(part, path)
    return catalog.read_ids(spark, path).groupBy("entry_id").agg(F.count("*").alias("n"))


@query(over(_VOXELS) + """, runs as (select *, k - row_number() over (partition by structure_id, i, j order by k) as run from vox)
    select structure_id, i, j, min(k) as lo, max(k) as hi from runs group by structure_id, i, j, run""")
def solid_runs(spark, sf_dir):
    """The solid of all balls as runs along its columns."""
    return tiles.runs(_balls(spark, sf_dir)[0])


@query(over(_POINTS, _SPANS) + "select structure_id, point, p.residue_idx, span, kind from p join spans using (structure_id) where p.residue_idx between start_residue and end_residue")
def points_in_spans(spark, sf_dir):
    """Backbone points with each secondary span that they lie in."""
    s = scene(spark, sf_dir)
    levels = intervals.levels_for(s.spans, "start_residue", "end_residue")
    met = intervals.within(s.points, s.spans, ["structure_id"], "residue_idx", "start_residue", "end_residue", levels)
    return met.select("structure_id", "point", "residue_idx", "span", "kind")
