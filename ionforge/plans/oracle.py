"""SQL for the registered queries, written apart from the operators."""

from __future__ import annotations

from ..operators.sample import PRIME, permutation_keys
from ..functions.constants import ALPHABET, CARBAMIDOMETHYL, HYDROGEN, PROTON, RESIDUE_MASS, WATER, scaled

_PROTEINS = "proteins as (select 'DOC_' || doc_id as accession, upper(regexp_replace(coalesce(text, ''), '[^A-Za-z]', '', 'g')) as sequence from documents)"
_DECOYS = "decoys as (select 'DECOY_' || accession as accession, reverse(sequence) as sequence from proteins)"
#: Cuts are marked behind each K and R, taken back before P, where W-K and M-R cut all the same.
_CUT = """string_split(rtrim(replace(replace(replace(replace(
    regexp_replace(sequence, '([KR])', '\\1|', 'g'), 'K|P', 'KP'), 'R|P', 'RP'), 'WKP', 'WK|P'), 'MRP', 'MR|P'), '|'), '|')"""


#: Cuts by enzyme, marked and split: behind a letter, before one, or between all.
_CUTS = {
    "trypsin": _CUT,
    "lysc": "string_split(replace(sequence, 'K', 'K|'), '|')",
    "argc": "string_split(replace(sequence, 'R', 'R|'), '|')",
    "aspn": "string_split(replace(sequence, 'D', '|D'), '|')",
    "chymotrypsin": "string_split(regexp_replace(regexp_replace(sequence, '([FYW])', '\\1|', 'g'), '([FYW])[|]P', '\\1P', 'g'), '|')",
    "gluc": "string_split(replace(sequence, 'E', 'E|'), '|')",
    "nonspecific": "string_split(sequence, '')",
}


def _peptides(name: str, source: str, missed: int = 0, low: int = 7, high: int = 42) -> str:
    runs = " union all ".join(f"select accession, unnest(list_transform(range(1, len(f) - {k - 1}), lambda i: array_to_string(f[i:i + {k}], ''))) as peptide from {name}_f" for k in range(missed + 1))
    return f"""{name}_f as (select accession, {_CUT} as f from {source}),
        {name}_all as ({runs}),
        {name} as (select distinct accession, peptide from {name}_all where length(peptide) between {low} and {high} and not regexp_matches(peptide, '[XUJZBO]'))"""


def _residues(p: str) -> str:
    return " + ".join(f"{scaled(m)} * (length({p}) - length(replace({p}, '{r}', '')))::bigint" for r, m in RESIDUE_MASS.items())


def _mass(p: str) -> str:
    return f"(({_residues(p)}) / 1e5 + {WATER})"


_T = f"with {_PROTEINS}, {_peptides('t', 'proteins')}, p as (select distinct peptide from t)"
_TD = f"with {_PROTEINS}, {_DECOYS}, {_peptides('t', 'proteins')}, {_peptides('r', 'decoys')}"
_SPECTRA = "s as (select event_id as spec_id, (1 + event_id % 6)::int as charge, 200 + 5 * value as precursor_mz from events)"
_PEPMASS = f"(precursor_mz - {HYDROGEN}) * charge"
_PEAKS = "k as (select l_partkey as spec_id, l_extendedprice / 50 as mz, l_quantity as intensity, row_number() over (partition by l_partkey order by l_extendedprice / 50, l_quantity, l_orderkey, l_linenumber) - 1 as pos from lineitem)"
_VECTORS = "v as (select vec_id as id, embedding::double[] as e, (500 + (vec_id * 7919) % 4500)::double as mass, label % 2 = 1 as is_decoy from embeddings)"
_BUCKETS = f"{_VECTORS}, lim as (select min(mass) as lo, (max(mass) - min(mass)) / 12 as w from v), b as (select v.*, greatest(0, least(11, floor((mass - lo) / w)::int)) as bucket from v, lim)"


def _knn(kind: str, squared: bool = True, name: str = "n") -> str:
    extra = "(q.mass - p.mass) * (q.mass - p.mass)" if kind == "narrow" else "bit_count(xor(q.bucket, p.bucket))"
    d = f"list_sum(list_transform(range(1, 65), lambda i: (q.e[i] - p.e[i]) * (q.e[i] - p.e[i]))) + {extra}"
    if not squared:
        d = f"sqrt({d})"
    return f"""{name}_d as (select q.id as query_id, p.id as db_id, round({d}, 9) as dist, p.is_decoy from b q, b p where q.id % 20 = 0),
        {name} as (select query_id, row_number() over (partition by query_id order by dist, db_id) as pos, db_id, round(dist, 6) as distance, is_decoy from {name}_d qualify pos <= 10)"""


_PSMS = """x as (select o_orderkey as psm_id, -floor(o_totalprice / 1000)::bigint as score, (o_custkey % 7 = 0 and o_totalprice < 250000) as is_decoy, o_totalprice % 900 - 200 as delta_mass from orders),
    y as (select * from x where delta_mass > -150 and delta_mass < 500)"""


def _q(source: str) -> str:
    return f"""g as (select score, count(*) filter (where not is_decoy) as n_target, count(*) filter (where is_decoy) as n_decoy from {source} group by score),
    c as (select *, sum(n_target) over (order by score) as ct, sum(n_decoy) over (order by score) as cd from g),
    f as (select *, case when ct = 0 then 'infinity'::double else cd::double / ct end as f from c),
    q as (select score, n_target, n_decoy, min(f) over (order by score range between current row and unbounded following) as q from f)"""


def _normal(d: str) -> str:
    return f"""with {_PEAKS}, d as (select spec_id, {d} as d from k group by spec_id)
        select spec_id, pos::int as pos, round(mz, 6) as mz, round(intensity / d, 9) as intensity from k join d using (spec_id)"""


_RESULTS = """r as (select 'raw' || (o_custkey % 3) as raw_file, (o_orderkey * 2)::int as scan, o_orderkey::int as index, round(o_totalprice / 100, 6) as "precursorMZ",
    round(o_totalprice / 50, 6) as pepmass, (2 + o_orderkey % 4)::int as charge, o_custkey % 7 = 0 as best_is_decoy, round(o_totalprice / 1e6, 6) as best_distance,
    floor(o_totalprice / 1000)::bigint as best_score, 'PEPTIDE' || repeat('K', (o_custkey % 5)::int) as best_peptide, round(o_totalprice / 50 + 1, 6) as peptide_mass,
    -1.0::double as delta_mass, 'P' || (o_custkey % 11) as accession from orders)"""


def _ions(source: str) -> str:
    """ions of (peptide, charge, ...) rows of ``source`` as one row each."""
    table = "map {" + ", ".join(f"'{r}': {m + (CARBAMIDOMETHYL if r == 'C' else 0)}::double" for r, m in RESIDUE_MASS.items()) + "}"
    return f"""pc as (select distinct peptide, charge from {source}),
    pr as (select peptide, charge, unnest(range(1, length(peptide) + 1)) as i from pc),
    ps as (select peptide, charge, i, sum({table}[substr(peptide, i::int, 1)]) over (partition by peptide, charge order by i) as b from pr),
    pt as (select *, max(b) over (partition by peptide, charge) as whole, coalesce(lag(b) over (partition by peptide, charge order by i), 0) as before from ps),
    neutral as (select peptide, charge, b as m from pt union all select peptide, charge, whole - before + {WATER} from pt),
    raw_ions as (select peptide, charge, (m + z * {PROTON}) / z as ion from neutral, (select unnest(range(1, 4)) as z) where z <= charge),
    ions as (select *, row_number() over (partition by peptide, charge order by ion) as k from raw_ions qualify k <= 200)"""


def _md5k(p: str, n: int | str) -> str:
    return f"(('0x' || substr(md5({p}), 1, 8))::bigint % {n})"


def _dealt(ids: str, copies: int = 1) -> str:
    """Every distinct peptide as a candidate of one spectrum of ``ids``, or of several."""
    drawn = f"select peptide, {_md5k('peptide', '(select max(n) from sp)')} as k from p"
    if copies > 1:
        drawn = f"select distinct peptide, {_md5k('peptide || salt', '(select max(n) from sp)')} as k from p, (select unnest(range(1, {copies + 1})) as salt)"
    return f"""sp as (select spec_id, row_number() over (order by spec_id) - 1 as k, count(*) over () as n from ({ids})),
    pk as ({drawn}),
    cand as (select spec_id, (2 + spec_id % 2)::int as charge, row_number() over (partition by spec_id order by peptide) as pos, peptide from pk join sp using (k))"""


_CANDIDATES = _dealt("select distinct l_partkey as spec_id from lineitem")
_SCORING = f"""{_PEAKS},
    top as (select *, row_number() over (partition by spec_id order by intensity desc, pos desc) as by_intensity from k qualify by_intensity <= 100),
    norm as (select spec_id, sqrt(sum(intensity * intensity)) as d from top group by spec_id),
    tp as (select spec_id, mz, intensity / d as intensity from top join norm using (spec_id)),
    {_ions('cand')},
    hits as (select c.spec_id, c.pos, c.peptide, count(*) as n, sum(intensity) as total from cand c join tp using (spec_id)
             where exists (select 1 from ions i where i.peptide = c.peptide and i.charge = c.charge and abs(tp.mz - i.ion) < 2.0) group by all),
    sc as (select c.spec_id, c.pos, c.peptide, coalesce(n, 0) as n_matched, round(case when coalesce(n, 0) > 4 then n * total else -coalesce(total, 0) end, 4) + 0.0 as score
           from cand c left join hits using (spec_id, pos, peptide) where c.spec_id in (select spec_id from tp))"""
_SCORED = f"{_CANDIDATES}, {_SCORING}"

def _permuted() -> str:
    """Stacked rows, numbered and permuted, the rounds written out; a number beyond the range is permuted again, up to six times."""
    steps, last = [], "z"
    for walk in range(7):
        cols = ["x as x0", "x0 // b as l0", "x0 % b as r0"]
        for i, (factor, summand) in enumerate(permutation_keys(7)):
            v = f"(({'r' if i % 2 == 0 else 'l'}{i} * {factor} + {summand}) % {PRIME})"
            h = f"(({v} * {v}) % {PRIME})"
            cols += [f"((l{i} + {h}) % a)::bigint as l{i + 1}", f"r{i} as r{i + 1}"] if i % 2 == 0 else [f"l{i} as l{i + 1}", f"((r{i} + {h}) % b)::bigint as r{i + 1}"]
        cols.append(f"case when {str(walk > 0).lower()} and x0 < n then x0 else l4 * b + r4 end as y")
        steps.append(f"w{walk} as (select id, copy, n, a, b, y as x from (select id, copy, n, a, b, {', '.join(cols)} from {last}))")
        last = f"w{walk}"
    return f"""with s as (select vec_id as id, unnest([0, 1])::bigint as copy from embeddings),
        m as (select count(*) as n, floor(sqrt(count(*)))::bigint as f from s), q as (select n, case when f * f < n then f + 1 else f end as a from m),
        z as (select id, copy, row_number() over (order by copy, id) - 1 as x, n, a, ceil(n / a)::bigint as b from s, q), {', '.join(steps)}
        select id, copy, x as place from {last}"""


def sql() -> dict[str, str]:
    stats = "count(*) as n, sum(length(peptide))::bigint as residues, min(peptide) as first, max(peptide) as last"
    return {
        "digest_peptides": f"with {_PROTEINS}, {_peptides('t', 'proteins')} select accession, peptide from t",
        "digest_missed_cleavage": f"with {_PROTEINS}, {_peptides('t', 'proteins', 2)} select accession, {stats} from t group by accession",
        "digest_semi": f"""with {_PROTEINS}, f as (select accession, unnest({_CUT}) as r from proteins),
            s as (select accession, r, unnest(range(8, least(15, length(r)) + 1)) as n from f),
            t as (select distinct accession, peptide from (select accession, left(r, n::int) as peptide from s union all select accession, right(r, n::int) from s) where not regexp_matches(peptide, '[XUJZBO]'))
            select accession, {stats} from t group by accession""",
        "peptide_protein_map": f"{_T} select peptide, count(*) as n, string_agg(accession, ',' order by accession) as accessions from t group by peptide",
        "decoy_reverse": f"with {_PROTEINS}, {_DECOYS} select accession, length(sequence)::bigint as n, md5(sequence) as md5 from decoys",
        "decoy_sanitize": f"{_TD} select peptide from r except select peptide from t",
        "decoy_overlap": f"{_TD} select peptide from t intersect select peptide from r",
        "target_decoy_union": f"{_TD} select distinct peptide, false as is_decoy from t union all select peptide, true from (select peptide from r except select peptide from t)",
        "database_sizes": f"""{_TD}, a as (select distinct peptide from t), b as (select distinct peptide from r), c as (select peptide from a intersect select peptide from b)
            select (select count(*) from a) as n_target, (select count(*) from b) as n_decoy, (select count(*) from c) as n_shared, (select count(*) from b) - (select count(*) from c) as n_kept""",
        "header_parse": """with c as (select c_custkey as id, c_name as name, c_mktsegment as segment from customer)
            select id, 'uniprot' as kind, string_split('sp|P' || id || '|' || name, ' ')[1] as accession, segment || ' one' as species, name || ' OS=' || segment || ' one' as protein from c
            union all select id, 'ncbi', 'NP_' || id, segment, name || ' like' from c
            union all select id, 'generic', string_split(name, ' ')[1], null, ' ' || name || ' ' || segment from c""",
        "enzyme_fragments": f"""with {_PROTEINS}, r as ({" union all ".join(f"select accession, '{k}' as enzyme, {v} as f from proteins" for k, v in _CUTS.items())})
            select accession, enzyme, len(list_filter(f, lambda x: x <> '')) as n, coalesce(list_sum(list_transform(f, lambda x: length(x)::bigint * length(x))), 0)::bigint as squares from r""",
        "mgf_fields": _mgf(),
        "usi_modifications": """with n as (select p_partkey, case when p_partkey % 3 = 0 then p_name else 'PEP[' || p_brand || ']TIDE' end as name, case when p_partkey % 3 = 0 then 'unmod.' else p_brand end as modification from part) select * from n""",
        "peptide_pad": f"{_T} select peptide, rpad(peptide, 42, '_') as padded from p",
        "peptide_encode": f"{_T} select peptide, array_to_string(list_transform(string_split(rpad(peptide, 42, '_'), ''), lambda c: instr('{ALPHABET}', c) - 1), ',') as ids from p",
        "peptide_mass": f"{_T} select peptide, round({_mass('peptide')}, 6) as mass from p",
        "mass_range_filter": f"{_T} select peptide, round({_mass('peptide')}, 6) as mass from p where round({_mass('peptide')}, 6) between 500 and 5000",
        "precursor_mass": f"with {_SPECTRA} select spec_id, charge, round({_PEPMASS}, 6) as pepmass from s",
        "spectrum_filter": f"with {_SPECTRA} select spec_id, charge, round({_PEPMASS}, 6) as pepmass from s where charge between 2 and 5 and round({_PEPMASS}, 6) between 500 and 5000",
        "delta_mass": f"""{_T}, {_SPECTRA}, {_dealt('select distinct spec_id from s')}
            select spec_id, peptide, round({_PEPMASS} - {_mass('peptide')}, 5) as delta_mass from s join (select spec_id, peptide from cand) using (spec_id)""",
        "normalize_ion_current": _normal("sum(intensity * intensity)"),
        "normalize_l2": _normal("sqrt(sum(intensity * intensity))"),
        "normalize_sum": _normal("sum(intensity)"),
        "normalize_max": _normal("max(intensity)"),
        "trim_peaks": f"""with {_PEAKS}, t as (select *, row_number() over (partition by spec_id order by intensity desc, pos desc) as r from k qualify r <= 10)
            select spec_id, (row_number() over (partition by spec_id order by pos) - 1)::int as pos, round(mz, 6) as mz, intensity from t""",
        "mass_buckets_uniform": f"with {_BUCKETS} select id, bucket::bigint as bucket from b",
        "mass_buckets_quantile": f"""with {_VECTORS}, o as (select mass, row_number() over (order by mass) as r, count(*) over () as n from v),
            e as (select distinct (select min(mass) from o where r >= ceil(n * k / 12.0)) as edge from (select unnest(range(1, 12)) as k), (select count(*) as n from v)),
            m as (select min(mass) as lo from v)
            select id, (select count(*) from e, m where edge <= v.mass and edge > lo)::bigint as bucket from v""",
        "bucket_sizes": f"with {_BUCKETS} select bucket::bigint as bucket, count(*) as n, min(id) as first, max(id) as last from b group by bucket",
        "bucket_window": f"""with {_BUCKETS}, w as (select id, greatest(0, least(11, floor((mass - 500.0 - lo) / w)::int)) as low, greatest(0, least(11, floor((mass + 500.0 - lo) / w)::int)) as high, lo, w from v, lim)
            select id, low::bigint as low, high::bigint as high, round(lo + w * low, 6) as low_edge, round(lo + w * (high + 1), 6) as high_edge from w""",
        "bucket_hamming": f"with {_BUCKETS}, n as (select distinct bucket from b) select x.bucket::bigint as a, y.bucket::bigint as b, bit_count(xor(x.bucket, y.bucket))::bigint as distance from n x, n y where x.bucket <= y.bucket",
        "search_space": f"""with {_BUCKETS}, n as (select bucket::bigint as bucket, count(*) as n from b group by bucket), t as (select sum(n) as total from n)
            select x.bucket as q, sum(y.n)::bigint as n, round(sum(y.n) / max(total), 6) as part from n x, n y, t where y.bucket between x.bucket - 1 and x.bucket + 1 group by x.bucket""",
        "knn_narrow": f"with {_BUCKETS}, {_knn('narrow')} select * from n",
        "knn_narrow_pruned": f"with {_BUCKETS}, {_knn('narrow')} select * from n",
        "knn_open": f"with {_BUCKETS}, {_knn('open')} select * from n",
        "fasta_files": f"with {_PROTEINS} select accession, length(sequence)::bigint as n, md5(sequence) as md5 from proteins",
        "decoy_files": f"with {_PROTEINS}, {_DECOYS} select accession, length(sequence)::bigint as n, md5(sequence) as md5 from decoys",
        "map_files": f"{_T} select peptide, count(*) as n, string_agg(accession, ',' order by accession) as accessions from t group by peptide",
        "pin_files": _pin(),
        "results_store": f"with {_RESULTS} select raw_file, index, best_peptide from r where raw_file = 'raw0' or raw_file = 'raw1' and index % 2 = 0",
        **dict.fromkeys(("mgf_files", "mgf_data_source"), f"select scan, precursor_mz, charge, n_peaks, total from ({_mgf()})"),
        "mass_window": f"{_T} select peptide, round({_mass('peptide')}, 6) as mass from p where {_mass('peptide')} between 1000 and 1200",
        "bucket_members": f"""with {_BUCKETS}, {_SPECTRA}, m as (select {_PEPMASS} as mass from s where charge = 2 and {_PEPMASS} between 1000 and 1100)
            select id, bucket::bigint as bucket from b where bucket in (select greatest(0, least(11, floor((m.mass - lo) / w)::int)) from m, lim)""",
        "sql_cleave": f"with {_PROTEINS}, {_peptides('t', 'proteins', 1)} select accession, peptide from t",
        "sql_fragments": f"""{_T}, pz as (select peptide, 2::bigint as charge from p), {_ions('pz')}
            select peptide, count(*) as n, round(min(ion), 4) as least, round(max(ion), 4) as most, round(sum(ion), 2) as total from ions group by peptide""",
        "search_documents": f"{_T} select count(*) as n, true as recovered from p where {_mass('peptide')} between 500 and 4000",
        "layout_preservation": f"with {_VECTORS} select count(*) as n, true as kept from v where id % 20 = 0",
        "row_slice": f"with {_SPECTRA}, o as (select *, row_number() over (order by charge, precursor_mz, spec_id) - 1 as k from s) select spec_id, charge, precursor_mz from o where k >= 400 and k < 500",
        "stacked_shuffle": _permuted(),
        "knn_open_pivots": f"with {_BUCKETS}, {_knn('open')} select * from n",
        "embed_peptides": f"{_T} select peptide, 64::int as width, 1.0::double as norm from p",
        "embed_trained": f"{_T} select peptide, 64::int as width, 1.0::double as norm from p",
        "trained_recall": f"{_T} select count(*) as n, true as better from p",
        "knn_unsquared": f"with {_BUCKETS}, {_knn('open', squared=False)} select * from n",
        "knn_union": f"with {_BUCKETS}, {_knn('narrow')}, {_knn('open', name='o')} select * from n union all select query_id, pos + 10, db_id, distance, is_decoy from o",
        "search_hybrid": f"""with {_BUCKETS}, {_knn('narrow')}, {_knn('open', name='o')},
            u as (select * from n union all select query_id, pos + 10, db_id, distance, is_decoy from o),
            best as (select query_id, db_id, distance as score, is_decoy from u qualify row_number() over (partition by query_id order by distance, pos desc) = 1),
            {_q('best')} select query_id, db_id, best.score, is_decoy, round(q.q, 6) as q from best join q on best.score = q.score""",
        "fragment_ions": f"""{_T}, pz as (select peptide, (2 + {_md5k('peptide', 2)})::bigint as charge from p), {_ions('pz')}
            select peptide, charge, count(*) as n, round(min(ion), 4) as least, round(max(ion), 4) as most, round(sum(ion), 2) as total from ions group by peptide, charge""",
        "ions_distinct": f"{_T}, {_CANDIDATES} select distinct peptide, charge::bigint as charge from cand",
        **dict.fromkeys(("match_score", "match_score_all"), f"{_T}, {_SCORED} select spec_id, pos, peptide, n_matched, score from sc"),
        **dict.fromkeys(("best_per_spectrum", "best_per_spectrum_all"), f"{_T}, {_SCORED} select spec_id, pos, peptide, score from sc qualify row_number() over (partition by spec_id order by score desc, pos desc) = 1"),
        "match_score_wide": f"{_T}, {_dealt('select distinct l_partkey as spec_id from lineitem', 4)}, {_SCORING} select spec_id, pos, peptide, n_matched, score from sc",
        "best_three": f"{_T}, {_SCORED} select spec_id, row_number() over (partition by spec_id order by score desc, pos desc) as rank, pos, peptide, score from sc qualify rank <= 3",
        **dict.fromkeys(
            ("peak_match", "peak_match_all"),
            f"""{_T}, {_CANDIDATES}, {_ions('cand')}, {_PEAKS}
            select k.spec_id, c.peptide, count(*) as n, sum(intensity) as intensity from k join cand c using (spec_id)
            where exists (select 1 from ions i where i.peptide = c.peptide and i.charge = c.charge and abs(k.mz - i.ion) < 2.0) group by all""",
        ),
        **dict.fromkeys(
            ("accession_join", "accession_join_all"),
            f"""{_T}, {_CANDIDATES} select spec_id, cand.peptide as best_peptide, accessions from cand
            join (select peptide, string_agg(accession, ',' order by accession) as accessions from t group by peptide) a using (peptide)""",
        ),
        "score_transform": """with v as (select o_orderkey as psm_id, (floor(o_totalprice / 1000)::bigint % 12 - 2)::double as raw from orders)
            select psm_id, raw, case when raw < -1 then 'nan' when raw = -1 then 'inf' else 'number' end as kind, case when raw > -1 then round(-ln(case when raw > -1 then raw + 1 else 1 end), 6) + 0.0 end as score from v""",
        "fdr_qvalues": f"with {_PSMS}, {_q('y')} select score, n_target, n_decoy, round(q, 6) as q from q",
        "fdr_filter": f"with {_PSMS}, {_q('y')} select psm_id, y.score, round(q.q, 6) as q from y join q using (score) where q.q <= 0.01 and not is_decoy",
        "identified_peptides": f"with {_PSMS}, {_q('y')} select count(distinct o.o_custkey) as n_peptides, count(*) as n from y join q using (score) join orders o on o.o_orderkey = y.psm_id where q.q <= 0.01 and not is_decoy",
        "pin_export": _pin(),
        "charge_onehot": f"with {_RESULTS} select index, {', '.join(f'(charge = {z})::int as charge{z}' for z in (2, 3, 4, 5))} from r",
        "inspect_view": f"with {_RESULTS} select * from r",
        "seeded_sample": f"with {_SPECTRA} select spec_id, charge, precursor_mz from s order by md5('42/' || spec_id), spec_id limit 20",
        "accuracy": f"with {_RESULTS} select round(avg(case when best_peptide = 'PEPTIDEK' then 1 else 0 end), 6) as accuracy from r",
        "vector_distances": f"""with {_VECTORS} select v.id, round(sqrt(list_sum(list_transform(v.e, lambda x: x * x)) + v.mass * v.mass), 4) as norm, round(list_distance(v.e, w.e), 5) as distance
            from v join v w on w.id = v.id + 1""",
        "space_union": f"""with {_BUCKETS}, w as (select unnest([1000.0, 1500.0]) as m), k as (select greatest(0, least(11, floor((m - 500.0 - lo) / w)::int)) as low, greatest(0, least(11, floor((m + 500.0 - lo) / w)::int)) as high from w, lim)
            select distinct id, bucket::bigint as bucket from b, k where bucket between low and high""",
        "score_argmax": f"{_T}, {_SCORED} select spec_id, max(score) as score, arg_max(pos, (score, pos))::bigint as pos from sc group by spec_id",
        "delta_mass_profile": f"with {_PSMS}, {_profile()} select * from h",
        "top_delta_bins": f"with {_PSMS}, {_profile()} select * from h order by n desc, bin desc limit 6",
    }


def _profile() -> str:
    return """d as (select delta_mass as d from x where abs(delta_mass) > 0.1 and abs(delta_mass) < 200), l as (select min(d) as lo, (max(d) - min(d)) / 10000 as w from d),
    h as (select least(9999, floor((d - lo) / w)::int)::bigint as bin, round(max(lo) + (least(9999, floor((d - lo) / w)::int) + 0.5) * max(w), 8) as center, count(*) as n from d, l group by least(9999, floor((d - lo) / w)::int))"""


def _mgf() -> str:
    return f"""with {_SPECTRA}, {_PEAKS}
            select s.spec_id, s.spec_id::int as scan, round(precursor_mz, 6) as precursor_mz, case when s.spec_id % 7 <> 0 then charge end as charge, count(*) as n_peaks, sum(round(mz * intensity * 5000)::bigint)::bigint as total
            from s join k using (spec_id) group by all"""


def _pin() -> str:
    return f"""with {_RESULTS} select raw_file, raw_file || '_' || index || '_' || index || '_' || charge as "SpecId", case when best_is_decoy then -1 else 1 end as "Label", scan as "ScanNr", "precursorMZ" as "ExpMass",
            1 as rank, best_score, best_distance, pepmass, delta_mass, length(best_peptide)::int as peptide_length, {', '.join(f'(charge = {z})::int as charge{z}' for z in (2, 3, 4, 5))},
            'X.' || best_peptide || '.X' as "Peptide", 'PROTEIN_0' as "Proteins" from r"""
