"""ANSI SQL twins of the catalog queries, run by an independent engine over the same tables.

Shared CTEs: ``he`` (health events), ``g`` (grounded distinct labels), ``hg`` (grounded
events).  Constants come from the lexicon as VALUES; all logic is restated in SQL.
"""

from __future__ import annotations

from carelattice.functions.text import STOP_WORDS
from carelattice.lexicon import Lexicon
from carelattice.plans.activity import VOCABULARY

LEX = Lexicon.default()


def lit(v) -> str:
    if v is None:
        return "NULL"
    if isinstance(v, bool):
        return "TRUE" if v else "FALSE"
    if isinstance(v, float):
        return f"CAST({v!r} AS DOUBLE)"
    if isinstance(v, int):
        return repr(v)
    if isinstance(v, (list, tuple)):
        return "[" + ", ".join(lit(x) for x in v) + "]::VARCHAR[]"
    return "'" + str(v).replace("'", "''") + "'"


def values(rows) -> str:
    return "(VALUES " + ", ".join("(" + ", ".join(lit(c) for c in r) + ")" for r in rows) + ")"


HE = f"""vocab(kind, slot, label, unit, lo, hi) AS {values(VOCABULARY)},
sizes AS (SELECT kind, COUNT(*) AS n FROM vocab GROUP BY kind),
typed AS (
  SELECT event_id, ts, user_id, value,
         CASE WHEN event_id % 41 = 0 THEN 'note' WHEN event_id % 37 = 0 THEN 'care_task'
              WHEN event_id % 29 = 0 THEN 'barrier'
              WHEN event_type = 'click' THEN 'medication' WHEN event_type = 'purchase' THEN 'lab'
              WHEN event_type = 'error' THEN 'condition'  WHEN event_type = 'signup' THEN 'symptom'
              ELSE 'vital' END AS kind
  FROM events),
he AS (
SELECT concat('evt_', t.event_id) AS event_id, t.event_id AS seq, t.user_id AS patient_id,
       concat('src_', t.user_id, '_', t.event_id % 7 % 3) AS source_id,
       CASE t.event_id % 7 % 3 WHEN 0 THEN 'emr' WHEN 1 THEN 'voice' ELSE 'doctor_note' END AS source_type,
       t.kind, v.label, v.unit,
       CASE WHEN v.lo IS NULL THEN NULL
            WHEN v.unit = 'mmHg' THEN concat(CAST(FLOOR(v.lo + t.value / 500.0 * (v.hi - v.lo)) AS INT), '/', CAST(FLOOR(60 + t.value / 500.0 * 45) AS INT))
            ELSE concat(CAST(FLOOR(v.lo + t.value / 500.0 * (v.hi - v.lo)) AS INT), '.', CAST(FLOOR((v.lo + t.value / 500.0 * (v.hi - v.lo)) * 10) AS BIGINT) % 10) END AS value,
       t.ts AS observed_at,
       CASE WHEN t.kind IN ('condition','medication') THEN CASE WHEN t.event_id % 11 = 0 THEN 'resolved' ELSE 'active' END END AS status
FROM typed t JOIN sizes s ON t.kind = s.kind JOIN vocab v ON v.kind = t.kind AND v.slot = t.event_id % s.n)"""

CONCEPT_COLS = ("concept_id, ckind, ccanonical, coding, category, system_group, ref_unit, ref_low, ref_high, "
                "cdirection, specialties, classes, monitor")
CONCEPTS = f"""concepts({CONCEPT_COLS}) AS {values(
    (c["concept_id"], c["kind"], c["canonical"],
     f"{c['coding_system']}:{c['coding_code']}" if c["coding_code"] else None, c["category"], c["system_group"],
     c["unit"], c["low"], c["high"], c["direction"], c["specialties"], c["drug_classes"], c["monitor_labs"])
    for c in LEX.concepts)}"""


def title(s: str) -> str:
    return (f"array_to_string(list_transform(range(1, length({s}) + 1), lambda i: CASE WHEN i = 1 OR NOT "
            f"regexp_matches(substr({s}, i - 1, 1), '[a-z0-9_]') THEN upper(substr({s}, i, 1)) "
            f"ELSE substr({s}, i, 1) END), '')")


GROUND = f"""{HE}, {CONCEPTS},
aliases(akey, akind, aid) AS {values(LEX.alias_rows())},
phrases(prio, pkey, pkind, pid) AS {values(LEX.phrase_rows())},
lab0 AS (SELECT DISTINCT kind, label, lower(trim(regexp_replace(label, '\\s+', ' ', 'g'))) AS txt,
  CASE WHEN kind IN ('condition','medication','symptom','lab') THEN kind WHEN kind = 'vital' THEN 'lab' END AS target FROM he),
inside AS (SELECT l.kind, l.label, arg_min(p.pid, p.prio) AS pid FROM lab0 l JOIN phrases p
  ON (l.target IS NULL OR l.target = p.pkind) AND strpos(l.txt, p.pkey) > 0
 AND (strpos(l.txt, p.pkey) = 1 OR NOT regexp_matches(substr(l.txt, strpos(l.txt, p.pkey) - 1, 1), '[a-z0-9]'))
 AND NOT regexp_matches(substr(l.txt, strpos(l.txt, p.pkey) + length(p.pkey), 1), '[a-z0-9]')
 GROUP BY l.kind, l.label),
g0 AS (SELECT l.kind, l.label, l.txt, l.target, coalesce(a.aid, i.pid) AS cid FROM lab0 l
 LEFT JOIN aliases a ON a.akey = l.txt AND (l.target IS NULL OR a.akind = l.target)
 LEFT JOIN inside i ON i.kind = l.kind AND i.label = l.label),
g AS (SELECT g0.kind, g0.label, c.*, c.concept_id IS NOT NULL AS known,
  coalesce(c.ckind, g0.target, 'condition') AS concept_kind,
  coalesce(c.ccanonical, {title('g0.txt')}) AS canonical
 FROM g0 LEFT JOIN concepts c ON c.concept_id = g0.cid),
hg AS (SELECT he.*, g.* EXCLUDE (kind, label) FROM he JOIN g ON g.kind = he.kind AND g.label = he.label)"""

TS = "strftime({}, '%Y-%m-%d %H:%M:%S.%f')"


def ts(col: str) -> str:
    return TS.format(col)


READ = """CASE WHEN regexp_matches(value, '[0-9]{2,3}/[0-9]{2,3}')
 THEN CAST(regexp_extract(value, '([0-9]{2,3})/([0-9]{2,3})', 1) AS DOUBLE)
 ELSE CAST(nullif(regexp_extract(value, '(-?[0-9]+(\\.[0-9]+)?)', 1), '') AS DOUBLE) END"""
JSNUM = "regexp_replace(CAST({} AS VARCHAR), '\\.0$', '')"


def num(x: str) -> str:
    return JSNUM.format(x)


def r2(x: str) -> str:
    return f"floor(({x}) * 100 + 0.5) / 100"


TRENDS = f"""series AS (SELECT *, {READ} AS v FROM hg WHERE kind IN ('lab', 'vital')),
t0 AS (SELECT patient_id, lower(canonical) AS series_key, min(canonical) AS label, min(ref_unit) AS ref_unit,
  min(cdirection) AS cdir, count(*) AS points, arg_min(v, (observed_at, seq)) AS fv, arg_max(v, (observed_at, seq)) AS lv,
  arg_max(unit, (observed_at, seq)) AS lu, min(observed_at) AS fo, max(observed_at) AS lo_, min(seq) AS first_numeric_seq
  FROM series WHERE v IS NOT NULL GROUP BY 1, 2 HAVING count(*) >= 2),
t1 AS (SELECT *, greatest(0.01, abs(fv) * 0.02) AS eps FROM t0),
t2 AS (SELECT *, CASE WHEN lv - fv > eps THEN 'rising' WHEN lv - fv < -eps THEN 'falling' ELSE 'stable' END AS moved FROM t1),
trends AS (SELECT patient_id, series_key, label, CASE WHEN coalesce(ref_unit, '') <> '' THEN ref_unit ELSE lu END AS unit,
  points, fv AS first_value, lv AS last_value,
  sign(lv - fv) * floor(abs(lv - fv) * 100 + 0.5) / 100 + 0.0 AS delta, moved AS direction,
  CASE WHEN moved = 'stable' THEN FALSE WHEN cdir = 'higher_worse' THEN moved = 'rising'
       WHEN cdir = 'lower_worse' THEN moved = 'falling' ELSE TRUE END AS worsening,
  fo AS first_observed_at, lo_ AS last_observed_at, first_numeric_seq FROM t2)"""

SOURCES = """sources AS (SELECT patient_id, source_id, source_type, min(observed_at) AS captured_at,
  concat(CASE source_type WHEN 'emr' THEN 'EMR import' WHEN 'voice' THEN 'Voice note' ELSE 'Doctor note' END, ' ', source_id) AS title,
  CASE WHEN source_type = 'voice' THEN concat('Patient ', patient_id, ' describes symptoms and medications.') END AS raw_text
  FROM he GROUP BY 1, 2, 3)"""


def score(n: str) -> str:
    return (f"floor(greatest(0.0::DOUBLE, least(1.0::DOUBLE, CASE source_type WHEN 'emr' THEN 0.9::DOUBLE WHEN 'doctor_note' THEN 0.85::DOUBLE "
            f"ELSE 0.8::DOUBLE END + CASE WHEN known THEN 0.08::DOUBLE ELSE 0.0::DOUBLE END "
            f"+ CASE WHEN quote IS NOT NULL THEN 0.05::DOUBLE ELSE 0.0::DOUBLE END "
            f"+ CASE WHEN coding IS NOT NULL THEN 0.05::DOUBLE ELSE 0.0::DOUBLE END "
            f"+ CASE WHEN {n} >= 2 THEN 0.1::DOUBLE ELSE 0.0::DOUBLE END + CASE WHEN {n} >= 3 THEN 0.05::DOUBLE ELSE 0.0::DOUBLE END)) "
            f"* 100.0::DOUBLE + 0.5::DOUBLE) / 100.0::DOUBLE")


PARSED = "CAST(nullif(regexp_extract(value, '(-?[0-9]+(\\.[0-9]+)?)', 1), '') AS DOUBLE)"
FLAG = f"""CASE WHEN {PARSED} IS NULL THEN 'unknown' WHEN {PARSED} > ref_high THEN 'high'
  WHEN {PARSED} < ref_low THEN 'low' WHEN ref_low IS NULL AND ref_high IS NULL THEN 'unknown' ELSE 'normal' END"""

FACTS = f"""{SOURCES},
cand0 AS (SELECT hg.* EXCLUDE (unit), coalesce(hg.unit, hg.ref_unit) AS unit, s.title AS source_title,
   CASE WHEN length(value) > 12 THEN value ELSE s.raw_text[1:240] END AS quote,
   CASE WHEN lower(label) IN ('patient-reported context') OR kind IN ('note', 'encounter') THEN 'evidence_only' ELSE 'graph' END AS relevance,
   CASE WHEN concept_kind = 'lab' THEN {FLAG} END AS lab_flag
  FROM hg JOIN sources s USING (patient_id, source_id)),
cand AS (SELECT *, {score('1')} AS confidence FROM cand0),
dedup AS (SELECT * FROM cand QUALIFY row_number() OVER (
   PARTITION BY patient_id, source_id, kind, canonical, observed_at, coalesce(value, '') ORDER BY seq) = 1),
agree AS (SELECT patient_id, kind, lower(canonical) AS k, count(DISTINCT source_id) AS source_count FROM dedup GROUP BY 1, 2, 3),
facts0 AS (SELECT d.* EXCLUDE (confidence), a.source_count, {score('a.source_count')} AS confidence
   FROM dedup d JOIN agree a ON a.patient_id = d.patient_id AND a.kind = d.kind AND a.k = lower(d.canonical)),
facts AS (SELECT *, CASE WHEN confidence < 0.75 THEN 'needs_review' ELSE 'accepted' END AS review_status FROM facts0)"""

CONTRA = """gf AS (SELECT *, concat(concept_kind, ':', lower(canonical)) AS concept_key FROM facts WHERE relevance = 'graph'),
con AS (SELECT patient_id, concept_key, count(*) AS facts, count(DISTINCT source_id) AS sources,
   coalesce(bool_or(status = 'active'), FALSE) AND coalesce(bool_or(status = 'resolved'), FALSE) AS conflicting,
   arg_min(canonical, seq) AS first_label, arg_min(kind, seq) AS first_kind
   FROM gf GROUP BY 1, 2 HAVING count(*) >= 2 AND count(DISTINCT source_id) >= 2),
sc AS (SELECT patient_id, concept_key, 'active-vs-resolved' AS tag, facts, sources, NULL::DATE AS day,
   concat('Conflicting status across sources for ', first_label, ': reported both active and resolved.') AS reason FROM con WHERE conflicting),
dy AS (SELECT patient_id, concept_key, CAST(observed_at AS DATE) AS day, min(seq) AS arrival, count(*) AS facts, min(v) AS mn, max(v) AS mx
   FROM (SELECT *, """ + READ + """ AS v FROM gf) GROUP BY 1, 2, 3
   HAVING count(v) >= 2 AND min(v) > 0 AND (max(v) - min(v)) / min(v) > 0.25),
vc AS (SELECT d.patient_id, d.concept_key, 'divergent-values' AS tag, d.facts, c.sources, d.day,
   concat('Divergent same-day values for ', c.first_label, ' (', """ + num("d.mn") + """, ' vs ', """ + num("d.mx") + """, ').') AS reason
   FROM dy d JOIN con c USING (patient_id, concept_key) WHERE NOT c.conflicting AND c.first_kind IN ('lab', 'vital')
   QUALIFY row_number() OVER (PARTITION BY d.patient_id, d.concept_key ORDER BY d.arrival) = 1),
contradictions AS (SELECT * FROM sc UNION ALL SELECT * FROM vc)"""


def sid_cte(name: str, base: str, prefix: str, expr: str, out: str) -> str:
    """CTE ``name``: rows of ``base`` plus column ``out`` = stable id of ``expr``."""
    steps = (f"list_reduce(list_prepend(0::HUGEINT, list_transform(range(1, length(_s) + 1), lambda i: "
             f"unicode(substr(_s, i, 1))::HUGEINT)), lambda a, b: (a * 31 + b) % 4294967296)")
    digits = ", ".join(
        f"CASE WHEN _h >= {36 ** i} OR {i} = 0 THEN substr('0123456789abcdefghijklmnopqrstuvwxyz', ((_h // {36 ** i}) % 36 + 1)::INT, 1) ELSE '' END"
        for i in range(6, -1, -1))
    return (f"{name} AS (SELECT * EXCLUDE (_s, _h), concat('{prefix}_', {digits}) AS {out} FROM "
            f"(SELECT *, {steps} AS _h FROM (SELECT *, {expr} AS _s FROM {base})))")


SIMILAR = """toks AS (SELECT label, list_distinct(list_filter(string_split(trim(regexp_replace(lower(label), '[^a-z0-9]+', ' ', 'g')), ' '), lambda t: length(t) > 1)) AS tk,
   regexp_replace(lower(label), '[^a-z0-9]', '', 'g') AS cl FROM (SELECT DISTINCT label FROM simlabels)),
grams AS (SELECT label, substr(cl, i::INT, 2) AS gram, count(*) AS c FROM (SELECT label, cl, unnest(range(1, length(cl))) AS i FROM toks) GROUP BY 1, 2),
gn AS (SELECT label, sum(c) AS n FROM grams GROUP BY 1),
ov AS (SELECT a.label AS la, b.label AS lb, sum(least(a.c, b.c)) AS o FROM grams a JOIN grams b USING (gram) GROUP BY 1, 2),
sim AS (SELECT a.label AS la, b.label AS lb, CASE WHEN a.label = b.label THEN 1.0 ELSE greatest(
   CASE WHEN len(a.tk) = 0 OR len(b.tk) = 0 THEN 0.0 ELSE len(list_intersect(a.tk, b.tk))::DOUBLE / (len(a.tk) + len(b.tk) - len(list_intersect(a.tk, b.tk))) END,
   coalesce(2.0::DOUBLE * ov.o / (ga.n + gb.n), 0.0)) END AS s
   FROM toks a CROSS JOIN toks b LEFT JOIN gn ga ON ga.label = a.label LEFT JOIN gn gb ON gb.label = b.label
   LEFT JOIN ov ON ov.la = a.label AND ov.lb = b.label)"""


def entities_cte(block: str = "concept_kind") -> str:
    own = f"({block}) <> concept_kind"
    return f"""ef AS (SELECT *, {block} AS block, CASE WHEN {own} THEN concat('label:', lower(canonical)) WHEN coding IS NOT NULL THEN concat('code:', coding)
   ELSE concat('label:', lower(canonical)) END AS ckey, CASE WHEN {own} THEN NULL ELSE concept_id END AS ecid FROM facts WHERE relevance = 'graph'),
cl AS (SELECT patient_id, block, ckey, min(seq) AS fs, count(*) AS n, min(ecid) AS ecid, arg_min(canonical, seq) AS label,
   min(confidence) AS confidence, bool_or(review_status = 'needs_review') AS nr, arg_min(kind, seq) AS fk FROM ef GROUP BY 1, 2, 3),
simlabels AS (SELECT DISTINCT label FROM cl), {SIMILAR},
edge AS (SELECT a.patient_id, a.block, a.ckey AS x, b.ckey AS y FROM cl a JOIN cl b ON a.patient_id = b.patient_id AND a.block = b.block AND a.ckey <> b.ckey
   JOIN sim ON sim.la = a.label AND sim.lb = b.label AND sim.s >= 0.84 WHERE a.ecid IS NULL OR b.ecid IS NULL),
reach AS (SELECT patient_id, block, ckey AS x, ckey AS y FROM cl UNION SELECT r.patient_id, r.block, r.x, e.y FROM reach r JOIN edge e
   ON e.patient_id = r.patient_id AND e.block = r.block AND e.x = r.y),
root AS (SELECT patient_id, block, x AS ckey, min(y) AS root FROM reach GROUP BY 1, 2, 3),
rooted AS (SELECT cl.*, root.root FROM cl JOIN root USING (patient_id, block, ckey)),
ent0 AS (SELECT patient_id, block AS kind, root, min(fs) AS first_seq, sum(n)::BIGINT AS facts, arg_min(ecid, fs) FILTER (WHERE ecid IS NOT NULL) AS concept_id,
   coalesce(arg_min(label, fs) FILTER (WHERE ecid IS NOT NULL), arg_min(label, (-n, -length(label), fs))) AS canonical_label,
   min(confidence) AS confidence, bool_or(nr) AS nr FROM rooted GROUP BY 1, 2, 3),
ent AS (SELECT e.*, concat(e.kind, ':', lower(e.canonical_label)) AS entity_key, c.category, c.system_group, c.coding, c.classes,
   CASE WHEN e.nr THEN 'needs_review' ELSE 'accepted' END AS review_status FROM ent0 e LEFT JOIN concepts c ON c.concept_id = e.concept_id),
mem AS (SELECT ef.patient_id, e.entity_key, ef.event_id AS fact_id, ef.event_id, ef.source_id, r.fs AS cluster_seq, ef.seq, ef.kind, ef.label, ef.value, ef.unit, ef.observed_at, ef.confidence, ef.review_status
   FROM ef JOIN rooted r ON r.patient_id = ef.patient_id AND r.block = ef.block AND r.ckey = ef.ckey
   JOIN ent e ON e.patient_id = r.patient_id AND e.kind = r.block AND e.root = r.root)"""


BARRIER_BLOCK = "CASE kind WHEN 'barrier' THEN 'barrier' WHEN 'care_task' THEN 'task' ELSE concept_kind END"

CRULES = f"crules(rule_no, rule_id, dclass, rcanon, rcat, severity, rationale, rspec, rq) AS " + values(
    (r["rule_no"], r["rule_id"], r["drug_class"], r["canonical"], r["category"], r["severity"], r["rationale"],
     r["specialties"], r["questions"]) for r in LEX.contraindications)
IRULES = "irules(rule_no, rule_id, ca, cb, severity, rationale, rspec, rq) AS " + values(
    (r["rule_no"], r["rule_id"], r["class_a"], r["class_b"], r["severity"], r["rationale"], r["specialties"],
     r["questions"]) for r in LEX.interactions)
RLINKS = "rlinks(lf, lt) AS " + values(LEX.risk_links)
LLINKS = "llinks(lab, lcanon, lcat) AS " + values(LEX.lab_links)
SEV = "CASE severity WHEN 'high' THEN 0.9::DOUBLE WHEN 'medium' THEN 0.8::DOUBLE ELSE 0.7::DOUBLE END"

REL = f"""{CRULES}, {IRULES}, {RLINKS}, {LLINKS},
rel1 AS (SELECT m.patient_id, m.entity_key AS fk, c.entity_key AS tk, 'contraindicated_with' AS relation, {SEV} AS confidence, severity, rationale,
   m.review_status AS fr, c.review_status AS tr FROM ent m JOIN crules r ON list_contains(m.classes, r.dclass)
   JOIN ent c ON c.patient_id = m.patient_id AND c.kind = 'condition' AND (c.canonical_label = r.rcanon OR c.category = r.rcat)
   WHERE m.kind = 'medication' QUALIFY row_number() OVER (PARTITION BY m.patient_id, m.entity_key, c.entity_key ORDER BY r.rule_no) = 1),
rel2 AS (SELECT a.patient_id, a.entity_key AS fk, b.entity_key AS tk, 'contraindicated_with' AS relation, {SEV} AS confidence, severity, rationale,
   a.review_status AS fr, b.review_status AS tr FROM ent a JOIN ent b ON a.patient_id = b.patient_id AND a.kind = 'medication' AND b.kind = 'medication' AND a.first_seq < b.first_seq
   JOIN irules r ON (list_contains(a.classes, r.ca) AND list_contains(b.classes, r.cb)) OR (list_contains(a.classes, r.cb) AND list_contains(b.classes, r.ca))
   QUALIFY row_number() OVER (PARTITION BY a.patient_id, a.entity_key, b.entity_key ORDER BY r.rule_no) = 1),
rel3 AS (SELECT a.patient_id, a.entity_key AS fk, b.entity_key AS tk, 'risk_factor_for' AS relation, 0.72::DOUBLE AS confidence, NULL::VARCHAR AS severity,
   concat(lf, ' is a recognized risk factor for ', lt, '.') AS rationale, a.review_status AS fr, b.review_status AS tr
   FROM ent a JOIN rlinks ON a.canonical_label = lf JOIN ent b ON b.patient_id = a.patient_id AND b.canonical_label = lt AND b.kind = 'condition' WHERE a.kind = 'condition'),
rel4 AS (SELECT l.patient_id, l.entity_key AS fk, c.entity_key AS tk, 'worsening_trend' AS relation, 0.8::DOUBLE AS confidence, NULL::VARCHAR AS severity,
   concat(l.canonical_label, ' is trending ', t.direction, ' (', {num('t.first_value')}, '→', {num('t.last_value')}, CASE WHEN coalesce(t.unit, '') <> '' THEN concat(' ', t.unit) ELSE '' END,
     '), consistent with worsening ', c.canonical_label, '.') AS rationale, l.review_status AS fr, c.review_status AS tr
   FROM ent l JOIN trends t ON t.patient_id = l.patient_id AND t.series_key = lower(l.canonical_label) AND t.worsening
   JOIN llinks k ON k.lab = l.canonical_label JOIN ent c ON c.patient_id = l.patient_id AND c.kind = 'condition' AND (c.canonical_label = k.lcanon OR c.category = k.lcat)
   WHERE l.kind = 'lab' QUALIFY row_number() OVER (PARTITION BY l.patient_id, l.entity_key ORDER BY c.first_seq) = 1),
sy AS (SELECT *, row_number() OVER (PARTITION BY patient_id, system_group ORDER BY first_seq) AS rk FROM ent WHERE kind = 'symptom' AND system_group IS NOT NULL),
rel5 AS (SELECT a.patient_id, a.entity_key AS fk, b.entity_key AS tk, 'possibly_related_to' AS relation, 0.6::DOUBLE AS confidence, NULL::VARCHAR AS severity,
   concat(a.canonical_label, ' and ', b.canonical_label, ' are both ', a.system_group, ' symptoms and may share a cause.') AS rationale, a.review_status AS fr, b.review_status AS tr
   FROM sy a JOIN sy b ON a.patient_id = b.patient_id AND a.system_group = b.system_group AND a.rk = 1 AND b.rk > 1),
rel6 AS (SELECT b.patient_id, b.entity_key AS fk, t.entity_key AS tk, 'barrier_to' AS relation, 0.65::DOUBLE AS confidence, NULL::VARCHAR AS severity,
   concat('"', b.canonical_label, '" may be obstructing care for ', t.canonical_label, '.') AS rationale, b.review_status AS fr, t.review_status AS tr
   FROM ent b JOIN ent t ON t.patient_id = b.patient_id AND t.kind IN ('condition', 'medication', 'lab') JOIN sim ON sim.la = b.canonical_label AND sim.lb = t.canonical_label AND sim.s >= 0.3
   WHERE b.kind = 'barrier' QUALIFY row_number() OVER (PARTITION BY b.patient_id, b.entity_key ORDER BY sim.s DESC, CASE t.kind WHEN 'condition' THEN 0 WHEN 'medication' THEN 1 ELSE 2 END, t.first_seq) = 1),
rels AS (SELECT patient_id, fk AS from_key, tk AS to_key, relation, confidence, severity, rationale,
   CASE WHEN confidence < 0.75 OR fr = 'needs_review' OR tr = 'needs_review' THEN 'needs_review' ELSE 'accepted' END AS review_status FROM
   (SELECT * FROM rel1 UNION ALL SELECT * FROM rel2 UNION ALL SELECT * FROM rel3 UNION ALL SELECT * FROM rel4 UNION ALL SELECT * FROM rel5 UNION ALL SELECT * FROM rel6))"""


def spec(x: str) -> str:
    return f"array_to_string(list_transform({x}, lambda s: replace(s, '_', ' ')), '; ')"


SOON = "CASE severity WHEN 'high' THEN 'Now' ELSE 'Next 2 weeks' END"
SUF = "CASE WHEN coalesce({0}, '') <> '' THEN concat(' ', {0}) ELSE '' END"
ALERTS = f"""{CRULES}, {IRULES},
meds AS (SELECT * FROM hg WHERE kind = 'medication'), conds AS (SELECT * FROM hg WHERE kind = 'condition'), lv AS (SELECT * FROM hg WHERE kind IN ('lab', 'vital')),
mc AS (SELECT m.patient_id, m.concept_id, m.classes, m.canonical, min(m.seq) AS ms, arg_min(m.event_id, m.seq) AS me FROM meds m GROUP BY 1, 2, 3, 4),
cm AS (SELECT mc.patient_id, mc.canonical, mc.ms, mc.me, r.*, c.event_id AS ce, c.seq AS cs, c.canonical AS cc FROM mc JOIN crules r ON list_contains(mc.classes, r.dclass)
   JOIN conds c ON c.patient_id = mc.patient_id AND (c.canonical = r.rcanon OR c.category = r.rcat)),
a1 AS (SELECT patient_id, 1 AS family, severity, concat(canonical, ' with ', arg_min(cc, cs)) AS title, {SOON} AS time_horizon, {spec('rspec')} AS specialty,
   rationale AS explanation, array_to_string(rq, '; ') AS questions, min(ms) AS k1, NULL::BIGINT AS k2, rule_no, concat('contra:', rule_id, ':', canonical) AS rule_key FROM cm
   GROUP BY patient_id, canonical, rule_no, rule_id, severity, rationale, rspec, rq),
mp AS (SELECT a.patient_id, a.canonical AS na, b.canonical AS nb, a.seq AS i, b.seq AS j, a.event_id AS ea, b.event_id AS eb, r.* FROM meds a JOIN meds b ON a.patient_id = b.patient_id AND a.seq < b.seq
   JOIN irules r ON (list_contains(a.classes, r.ca) AND list_contains(b.classes, r.cb)) OR (list_contains(a.classes, r.cb) AND list_contains(b.classes, r.ca))
   QUALIFY row_number() OVER (PARTITION BY a.patient_id, a.canonical, b.canonical ORDER BY a.seq, b.seq, r.rule_no) = 1),
a2 AS (SELECT patient_id, 2, severity, concat(na, ' + ', nb, ' interaction'), {SOON}, {spec('rspec')}, rationale, array_to_string(rq, '; '), i, j, rule_no, concat('inter:', rule_id, ':', na, ':', nb) FROM mp),
latest AS (SELECT *, min(seq) OVER (PARTITION BY patient_id, canonical) AS first_seq FROM lv QUALIFY row_number() OVER (PARTITION BY patient_id, canonical ORDER BY observed_at DESC, seq) = 1),
lf AS (SELECT *, CASE WHEN regexp_matches(value, '[0-9]{{2,3}}/[0-9]{{2,3}}') THEN CAST(string_split(value, '/')[1] AS DOUBLE) END AS sys,
   CASE WHEN regexp_matches(value, '[0-9]{{2,3}}/[0-9]{{2,3}}') THEN CAST(string_split(value, '/')[2] AS DOUBLE) END AS dia, {FLAG} AS flag FROM latest),
lc AS (SELECT *, CASE WHEN flag IN ('normal', 'unknown') THEN FALSE WHEN cdirection = 'two_sided' THEN TRUE WHEN cdirection = 'higher_worse' THEN flag = 'high'
   WHEN cdirection = 'lower_worse' THEN flag = 'low' ELSE FALSE END AS concerning FROM lf),
a3 AS (SELECT patient_id, 3, CASE WHEN sys >= 160 OR dia >= 100 THEN 'high' ELSE 'medium' END, 'Elevated blood pressure', 'Next 2 weeks', 'primary care; cardiology',
   concat('Most recent blood pressure was ', {num('sys')}, '/', {num('dia')}, ' mmHg, above the usual ≥140/90 threshold for concern.'),
   'Is my blood pressure regimen still adequate?; Should I monitor my blood pressure at home?', first_seq, NULL::BIGINT, 0, concat('bp:', event_id)
   FROM lc WHERE canonical = 'Blood pressure' AND sys IS NOT NULL AND (sys >= 140 OR dia >= 90)
  UNION ALL SELECT patient_id, 3, 'medium', concat(canonical, ' out of range'), 'Next 2 weeks', CASE WHEN len(specialties) > 0 THEN {spec('specialties')} ELSE 'primary care' END,
   concat('Most recent ', canonical, ' of ', value, {SUF.format('unit')}, ' is ', flag, ' relative to its reference range.'),
   concat('What is causing my ', canonical, ' to be ', flag, '?; Do I need a repeat test or treatment change?'), first_seq, NULL::BIGINT, 0, concat('lab:', event_id)
   FROM lc WHERE NOT (canonical = 'Blood pressure' AND sys IS NOT NULL) AND concerning),
tsp AS (SELECT patient_id, canonical, any_value(specialties) AS sp FROM lv GROUP BY 1, 2),
a4 AS (SELECT t.patient_id, 4, 'medium', concat(t.label, ' worsening trend'), 'Next 90 days', CASE WHEN len(sp) > 0 THEN {spec('sp')} ELSE 'primary care' END,
   concat(t.label, ' has moved ', t.direction, ' from ', {num('t.first_value')}, ' to ', {num('t.last_value')}, {SUF.format('t.unit')}, ' across ', t.points, ' readings, a clinically unfavorable direction.'),
   concat('Why is my ', t.label, ' trending the wrong way?; Does my treatment plan need to change?'), t.first_numeric_seq, NULL::BIGINT, 0, concat('trend:', t.label)
   FROM trends t JOIN tsp ON tsp.patient_id = t.patient_id AND tsp.canonical = t.label WHERE t.worsening),
gaps AS (SELECT m.patient_id, m.canonical, m.monitor, min(m.seq) AS first_seq, arg_min(m.event_id, m.seq) AS first_event FROM meds m WHERE len(m.monitor) > 0
   AND NOT EXISTS (SELECT 1 FROM lv WHERE lv.patient_id = m.patient_id AND list_contains(m.monitor, lv.canonical)) GROUP BY 1, 2, 3),
a5 AS (SELECT patient_id, 5, 'low', concat('Monitoring gap for ', canonical), 'Next visit', 'pharmacy; primary care',
   concat(canonical, ' typically requires monitoring of ', array_to_string(monitor, ', '), ', but no recent results are on file.'),
   concat('Should I have ', array_to_string(monitor, ' or '), ' checked?'), first_seq, NULL::BIGINT, 0, concat('monitor:', canonical) FROM gaps),
a6 AS (SELECT patient_id, 6, 'medium', concat('Care barrier: ', label), 'Next appointment', 'primary care', concat('A reported barrier ("', label, '") may be interrupting needed care or medication.'),
   'Can you help me resolve this barrier to care?; What should I do in the meantime?', seq, NULL::BIGINT, 0, concat('barrier:', event_id) FROM he WHERE kind = 'barrier'),
every AS (SELECT * FROM a1 UNION ALL SELECT * FROM a2 UNION ALL SELECT * FROM a3 UNION ALL SELECT * FROM a4 UNION ALL SELECT * FROM a5 UNION ALL SELECT * FROM a6),
alerts AS (SELECT *, lower(title) AS alert_key, CASE severity WHEN 'high' THEN 0 WHEN 'medium' THEN 1 ELSE 2 END AS severity_rank FROM every
   QUALIFY row_number() OVER (PARTITION BY patient_id, lower(title) ORDER BY family, k1, k2 NULLS FIRST, rule_no) = 1),
ev AS (SELECT a.patient_id, a.alert_key, cm.me AS event_id FROM alerts a JOIN cm ON a.rule_key = concat('contra:', cm.rule_id, ':', cm.canonical) AND cm.patient_id = a.patient_id
  UNION SELECT a.patient_id, a.alert_key, cm.ce FROM alerts a JOIN cm ON a.rule_key = concat('contra:', cm.rule_id, ':', cm.canonical) AND cm.patient_id = a.patient_id
  UNION SELECT a.patient_id, a.alert_key, e FROM alerts a JOIN (SELECT patient_id, na, nb, rule_id, unnest([ea, eb]) AS e FROM mp) m ON m.patient_id = a.patient_id AND a.rule_key = concat('inter:', m.rule_id, ':', m.na, ':', m.nb)
  UNION SELECT patient_id, alert_key, string_split(rule_key, ':')[2] FROM alerts WHERE family IN (3, 6)
  UNION SELECT a.patient_id, a.alert_key, lv.event_id FROM alerts a JOIN lv ON lv.patient_id = a.patient_id AND a.rule_key = concat('trend:', lv.canonical)
  UNION SELECT a.patient_id, a.alert_key, g.first_event FROM alerts a JOIN gaps g ON g.patient_id = a.patient_id AND a.rule_key = concat('monitor:', g.canonical))"""


def with_(*ctes: str, recursive: bool = False) -> str:
    return ("WITH RECURSIVE " if recursive else "WITH ") + ",\n".join(ctes) + "\n"


STOPS = lit(list(STOP_WORDS))
