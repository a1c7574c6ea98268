"""Default clinical lexicon and rule tables.

Every table is fixed reference data written out as text: one row per line,
cells separated by ``|``, list cells separated by ``;``.  ``Lexicon.default``
turns them into small DataFrames.  A caller may build a ``Lexicon`` from other
rows; nothing downstream depends on these particular values.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

# --- fixed values -----------------------------------------------------------
# canonical | aliases | coding system : code : display | category | specialties
CONDITIONS = """
Chronic kidney disease | ckd; kidney disease; chronic renal disease; renal insufficiency; chronic renal failure | SNOMED:709044004:Chronic kidney disease | renal | nephrology; primary_care
Acute kidney injury | aki; acute renal failure; acute kidney failure | | renal | nephrology
Type 2 diabetes | diabetes; diabetes mellitus; t2dm; type 2 dm; dm2; type ii diabetes | SNOMED:44054006:Type 2 diabetes mellitus | metabolic | endocrinology; primary_care
Type 1 diabetes | t1dm; type 1 dm; dm1 | | metabolic | endocrinology
Hypertension | htn; high blood pressure; elevated blood pressure | SNOMED:38341003:Hypertensive disorder | cardiac | cardiology; primary_care
Heart failure | chf; congestive heart failure; hfref; hfpef; cardiac failure | | cardiac | cardiology
Coronary artery disease | cad; ischemic heart disease; coronary heart disease | | cardiac | cardiology
Atrial fibrillation | afib; a-fib; atrial fib | | cardiac | cardiology
Hyperlipidemia | high cholesterol; dyslipidemia; hypercholesterolemia | | metabolic | cardiology; primary_care
Asthma | reactive airway disease | | respiratory | pulmonology; primary_care
COPD | chronic obstructive pulmonary disease; emphysema; chronic bronchitis | | respiratory | pulmonology
Hypothyroidism | underactive thyroid; low thyroid | | endocrine | endocrinology; primary_care
Hyperkalemia | high potassium; elevated potassium | | electrolyte | nephrology; primary_care
Anemia | low hemoglobin; low blood count | | hematologic | primary_care
Depression | major depressive disorder; mdd | | psychiatric | psychiatry; primary_care
Anxiety | generalized anxiety disorder; gad | | psychiatric | psychiatry; primary_care
Osteoarthritis | oa; degenerative joint disease; djd | | musculoskeletal | rheumatology; primary_care
Gout | gouty arthritis | | musculoskeletal | rheumatology; primary_care
GERD | gastroesophageal reflux disease; acid reflux; reflux | | gastrointestinal | gastroenterology; primary_care
"""

# canonical | aliases | coding | drug classes | labs to monitor
MEDICATIONS = """
Ibuprofen | advil; motrin; nsaid; nsaids; naproxen; aleve; diclofenac; celecoxib; meloxicam; indomethacin | RxNorm:5640:Ibuprofen | nsaid |
Lisinopril | zestril; prinivil; enalapril; ramipril; benazepril; captopril | RxNorm:29046:Lisinopril | ace_inhibitor | Potassium; Creatinine; eGFR
Losartan | cozaar; valsartan; olmesartan; irbesartan; candesartan; telmisartan | | arb | Potassium; Creatinine; eGFR
Metoprolol | lopressor; toprol; atenolol; carvedilol; bisoprolol; propranolol | | beta_blocker |
Amlodipine | norvasc; diltiazem; verapamil; nifedipine | | calcium_channel_blocker |
Furosemide | lasix; bumetanide; torsemide | | loop_diuretic | Potassium; Creatinine
Hydrochlorothiazide | hctz; chlorthalidone | | thiazide_diuretic | Potassium; Sodium
Spironolactone | aldactone; eplerenone; amiloride; triamterene | | potassium_sparing_diuretic | Potassium
Metformin | glucophage; fortamet | RxNorm:6809:Metformin | biguanide | eGFR; HbA1c; Creatinine
Glipizide | glucotrol; glyburide; glimepiride | | sulfonylurea |
Empagliflozin | jardiance; dapagliflozin; farxiga; canagliflozin; invokana | | sglt2_inhibitor | eGFR
Sitagliptin | januvia; linagliptin; saxagliptin | | dpp4_inhibitor |
Semaglutide | ozempic; wegovy; dulaglutide; trulicity; liraglutide | | glp1_agonist |
Insulin | lantus; humalog; novolog; glargine; lispro; insulin glargine | | insulin | HbA1c
Atorvastatin | lipitor; simvastatin; rosuvastatin; crestor; pravastatin | | statin | LDL
Warfarin | coumadin; apixaban; eliquis; rivaroxaban; xarelto; dabigatran | | anticoagulant | INR
Aspirin | asa; clopidogrel; plavix | | antiplatelet |
Omeprazole | prilosec; pantoprazole; protonix; esomeprazole; nexium | | ppi |
Prednisone | prednisolone; methylprednisolone; dexamethasone | | corticosteroid | Glucose
Levothyroxine | synthroid; levoxyl | | thyroid_hormone | TSH
Sertraline | zoloft; fluoxetine; prozac; citalopram; escitalopram; lexapro | | ssri |
Albuterol | ventolin; proair; salbutamol | | bronchodilator |
"""

# canonical | aliases | coding | unit | low | high | direction | specialties
LABS = """
eGFR | egfr; estimated gfr; glomerular filtration rate; gfr | LOINC:33914-3:Estimated glomerular filtration rate | mL/min/1.73m2 | 60 | | lower_worse | nephrology
Creatinine | creat; serum creatinine; scr | | mg/dL | 0.6 | 1.3 | higher_worse | nephrology
Potassium | k; k+; serum potassium | LOINC:2823-3:Potassium [Moles/volume] in Serum or Plasma | mmol/L | 3.5 | 5.0 | two_sided | nephrology; cardiology
Sodium | na; na+; serum sodium | | mmol/L | 135 | 145 | two_sided |
HbA1c | a1c; hemoglobin a1c; glycated hemoglobin; hgba1c | LOINC:4548-4:Hemoglobin A1c/Hemoglobin.total in Blood | % | | 5.7 | higher_worse | endocrinology
Glucose | blood glucose; fasting glucose; fbg; blood sugar | | mg/dL | 70 | 99 | two_sided | endocrinology
LDL | ldl cholesterol; low density lipoprotein; ldl-c | | mg/dL | | 100 | higher_worse | cardiology
Hemoglobin | hgb; hb | | g/dL | 12 | 17 | lower_worse |
TSH | thyroid stimulating hormone; thyrotropin | | mIU/L | 0.4 | 4.0 | two_sided | endocrinology
INR | international normalized ratio; prothrombin | | | 0.8 | 1.2 | two_sided |
Blood pressure | bp; systolic; diastolic | | mmHg | | | higher_worse | cardiology; primary_care
"""

# canonical | aliases | organ system
SYMPTOMS = """
Shortness of breath | sob; dyspnea; breathless; can't catch my breath; trouble breathing; winded | cardiopulmonary
Edema | swelling; ankle swelling; leg swelling; fluid retention; puffy | cardiopulmonary
Chest pain | chest pressure; chest tightness; angina | cardiopulmonary
Palpitations | racing heart; heart pounding; fluttering | cardiopulmonary
Fatigue | tired; exhaustion; low energy; worn out | constitutional
Dizziness | lightheaded; vertigo; dizzy | neurologic
Headache | head pain; migraine | neurologic
Nausea | queasy; sick to stomach | gastrointestinal
Knee pain | joint pain; arthralgia; leg pain | musculoskeletal
Cough | coughing | cardiopulmonary
Polyuria | frequent urination; urinating often | genitourinary
Weight gain | gained weight | constitutional
"""

# id | drug class | condition canonical | condition category | severity | specialties | rationale | questions
CONTRAINDICATIONS = """
nsaid_ckd | nsaid | | renal | high | nephrology; pharmacy; primary_care | NSAIDs reduce renal blood flow and can accelerate kidney injury and raise potassium in chronic kidney disease, especially alongside ACE inhibitors or ARBs. | Should I stop NSAIDs and use a kidney-safe pain option instead?; How often should my kidney function and potassium be rechecked?
nsaid_hf | nsaid | Heart failure | | high | cardiology; pharmacy | NSAIDs cause sodium and fluid retention that can worsen heart failure and blunt diuretic effectiveness. | Is there a safer pain reliever given my heart failure?
nsaid_htn | nsaid | Hypertension | | medium | primary_care; cardiology; pharmacy | NSAIDs can raise blood pressure and reduce the effect of several antihypertensives. | Could NSAIDs be keeping my blood pressure high?
metformin_ckd | biguanide | | renal | medium | endocrinology; nephrology; pharmacy | Metformin requires dose adjustment or discontinuation as kidney function declines because of lactic acidosis risk; confirm current eGFR. | Is metformin still safe at my current kidney function?
ace_hyperkalemia | ace_inhibitor | Hyperkalemia | | high | nephrology; cardiology; pharmacy | ACE inhibitors raise serum potassium and can be dangerous when potassium is already elevated. | Should my ACE inhibitor dose change given my potassium?
arb_hyperkalemia | arb | Hyperkalemia | | high | nephrology; cardiology; pharmacy | ARBs raise serum potassium and can be dangerous when potassium is already elevated. | Should my ARB dose change given my potassium?
corticosteroid_diabetes | corticosteroid | | metabolic | medium | endocrinology; pharmacy | Corticosteroids raise blood glucose and can destabilize diabetes control. | How should I monitor my blood sugar while on steroids?
nsaid_anticoagulant_gi | nsaid | GERD | | medium | gastroenterology; pharmacy | NSAIDs increase the risk of GI bleeding and ulceration, compounding reflux disease. | Do I need stomach protection if I keep taking NSAIDs?
"""

# id | class a | class b | severity | specialties | rationale | questions
INTERACTIONS = """
ace_potassium_sparing | ace_inhibitor | potassium_sparing_diuretic | high | cardiology; nephrology; pharmacy | Combining an ACE inhibitor with a potassium-sparing diuretic substantially raises hyperkalemia risk. | Is it safe to take these two together for my potassium?
arb_potassium_sparing | arb | potassium_sparing_diuretic | high | cardiology; nephrology; pharmacy | Combining an ARB with a potassium-sparing diuretic substantially raises hyperkalemia risk. | Is it safe to take these two together for my potassium?
ace_arb | ace_inhibitor | arb | high | cardiology; nephrology; pharmacy | Dual ACE inhibitor + ARB therapy increases kidney injury and hyperkalemia risk without added benefit for most patients. | Do I really need both an ACE inhibitor and an ARB?
anticoagulant_nsaid | anticoagulant | nsaid | high | pharmacy; cardiology | NSAIDs added to anticoagulation markedly increase bleeding risk. | What pain reliever is safe while I'm on a blood thinner?
anticoagulant_antiplatelet | anticoagulant | antiplatelet | high | cardiology; pharmacy | Combining an anticoagulant with an antiplatelet increases bleeding risk and needs a clear indication. | Do I need both a blood thinner and aspirin?
ssri_anticoagulant | ssri | anticoagulant | medium | pharmacy; psychiatry | SSRIs can increase bleeding risk when combined with anticoagulants. | Does my antidepressant raise bleeding risk with my blood thinner?
opioid_benzodiazepine | opioid | benzodiazepine | high | pharmacy; primary_care | Concurrent opioids and benzodiazepines increase the risk of respiratory depression and overdose. | Is it safe to take these sedating medications together?
"""

# condition | condition it raises the risk of
RISK_LINKS = """
Type 2 diabetes | Chronic kidney disease
Hypertension | Chronic kidney disease
Hypertension | Heart failure
Hypertension | Coronary artery disease
Type 2 diabetes | Coronary artery disease
Hyperlipidemia | Coronary artery disease
Coronary artery disease | Heart failure
Atrial fibrillation | Heart failure
Chronic kidney disease | Hyperkalemia
Chronic kidney disease | Anemia
"""

# lab | condition canonical | condition category
LAB_LINKS = """
eGFR | | renal
Creatinine | | renal
HbA1c | | metabolic
Glucose | | metabolic
LDL | Hyperlipidemia |
Blood pressure | Hypertension |
Potassium | Hyperkalemia |
TSH | Hypothyroidism |
"""

# relation | domain node kinds | range node kinds | symmetric
RELATION_TYPES = """
has_condition | patient | condition | no
takes | patient | medication | no
reported | patient | symptom; conversation | no
ordered | patient | lab | no
managed_by | condition; patient | clinician; encounter | no
mentioned_in | * | source | no
belongs_to_visit | * | encounter | no
worsening_trend | lab | condition; lab | no
risk_factor_for | condition; medication; lab | condition | no
contraindicated_with | medication | condition; medication | yes
needs_follow_up | patient; condition; lab | task | no
barrier_to | barrier | condition; medication; task; lab | no
possibly_related_to | * | * | yes
"""

NODE_KINDS = ("patient", "condition", "symptom", "medication", "lab", "clinician",
              "encounter", "risk", "source", "task", "barrier", "conversation")
EVENT_KINDS = ("condition", "symptom", "medication", "lab", "vital",
               "encounter", "care_task", "barrier", "note")
SOURCE_TYPES = ("emr", "voice", "doctor_note", "manual")
CONCEPT_KINDS = ("condition", "medication", "lab", "symptom")
REPORT_SPECIALTIES = ("primary_care", "cardiology", "nephrology", "endocrinology", "pharmacy")
SEVERITY_CONFIDENCE = {"high": 0.9, "medium": 0.8, "low": 0.7}
# --- end of fixed values ----------------------------------------------------


def _rows(table: str) -> list[list[str]]:
    return [[c.strip() for c in line.split("|")] for line in table.strip().splitlines()]


def _items(cell: str) -> list[str]:
    return [p.strip() for p in cell.split(";") if p.strip()]


_TABLES: dict[tuple, DataFrame] = {}


def local_table(spark: SparkSession, rows: list[tuple], schema: pa.Schema) -> DataFrame:
    """A constant dimension table.  Built through Arrow so Catalyst sees a local
    relation of exactly known size and picks the broadcast itself."""
    key = (spark.sparkContext.applicationId, repr(rows), schema.to_string())
    if key not in _TABLES:
        _TABLES[key] = _local_table(spark, rows, schema)
    return _TABLES[key]


def _local_table(spark: SparkSession, rows: list[tuple], schema: pa.Schema) -> DataFrame:
    cols = list(zip(*rows)) if rows else [[] for _ in schema]
    arrays = [pa.array(list(c), type=f.type) for c, f in zip(cols, schema)]
    return spark.createDataFrame(pa.Table.from_arrays(arrays, schema=schema))


_S, _L, _D, _I, _B = pa.string(), pa.list_(pa.string()), pa.float64(), pa.int32(), pa.bool_()


def _schema(**fields: pa.DataType) -> pa.Schema:
    return pa.schema(list(fields.items()))


@dataclass(frozen=True)
class Lexicon:
    """Concept rows plus rule rows, in declaration order (the order decides ties)."""

    concepts: tuple[dict, ...]
    contraindications: tuple[dict, ...]
    interactions: tuple[dict, ...]
    risk_links: tuple[tuple[str, str], ...]
    lab_links: tuple[tuple[str, str | None, str | None], ...]
    relation_types: tuple[tuple[str, tuple[str, ...], tuple[str, ...], bool], ...]

    @staticmethod
    @lru_cache(maxsize=1)
    def default() -> "Lexicon":
        concepts: list[dict] = []

        def add(kind, canonical, aliases, coding="", **attrs):
            system, code, display = (coding.split(":", 2) + ["", "", ""])[:3] if coding else ("", "", "")
            concepts.append(dict(
                concept_id=len(concepts), kind=kind, canonical=canonical, aliases=_items(aliases),
                coding_system=system or None, coding_code=code or None, coding_display=display or None,
                category=attrs.get("category") or None, system_group=attrs.get("group") or None,
                unit=attrs.get("unit"), low=attrs.get("low"), high=attrs.get("high"),
                direction=attrs.get("direction"), specialties=attrs.get("specialties", []),
                drug_classes=attrs.get("classes", []), monitor_labs=attrs.get("monitor", [])))

        def num(cell):
            return float(cell) if cell else None

        for canonical, aliases, coding, category, spec in _rows(CONDITIONS):
            add("condition", canonical, aliases, coding, category=category, specialties=_items(spec))
        for canonical, aliases, coding, classes, monitor in _rows(MEDICATIONS):
            add("medication", canonical, aliases, coding, classes=_items(classes), monitor=_items(monitor))
        for canonical, aliases, coding, unit, low, high, direction, spec in _rows(LABS):
            add("lab", canonical, aliases, coding, unit=unit, low=num(low), high=num(high),
                direction=direction, specialties=_items(spec))
        for canonical, aliases, group in _rows(SYMPTOMS):
            add("symptom", canonical, aliases, group=group)

        contra = tuple(
            dict(rule_no=i, rule_id=r[0], drug_class=r[1], canonical=r[2] or None, category=r[3] or None,
                 severity=r[4], specialties=_items(r[5]), rationale=r[6], questions=_items(r[7]))
            for i, r in enumerate(_rows(CONTRAINDICATIONS)))
        # "lactic acidosis risk; confirm" must stay one rationale: only list cells are split on ';'
        inter = tuple(
            dict(rule_no=i, rule_id=r[0], class_a=r[1], class_b=r[2], severity=r[3],
                 specialties=_items(r[4]), rationale=r[5], questions=_items(r[6]))
            for i, r in enumerate(_rows(INTERACTIONS)))
        return Lexicon(
            tuple(concepts), contra, inter,
            tuple((a, b) for a, b in _rows(RISK_LINKS)),
            tuple((a, b or None, c or None) for a, b, c in _rows(LAB_LINKS)),
            tuple((r, tuple(_items(d)), tuple(_items(g)), s == "yes") for r, d, g, s in _rows(RELATION_TYPES)))

    # -- derived rows --------------------------------------------------------
    def alias_rows(self) -> list[tuple[str, str, int]]:
        """(key, kind, concept_id); the first declaration of a key wins."""
        seen: dict[str, tuple[str, str, int]] = {}
        for c in self.concepts:
            for key in [c["canonical"], *c["aliases"]]:
                norm = key.strip().lower()
                seen.setdefault(norm, (norm, c["kind"], c["concept_id"]))
        return list(seen.values())

    def phrase_rows(self) -> list[tuple[int, str, str, int]]:
        """(priority, key, kind, concept_id) for word containment, keys of 3+ characters."""
        out = []
        for c in self.concepts:
            for key in [c["canonical"], *c["aliases"]]:
                if len(key) >= 3:
                    out.append((len(out), key.lower(), c["kind"], c["concept_id"]))
        return out

    # -- DataFrames ----------------------------------------------------------
    def aliases(self, spark: SparkSession) -> DataFrame:
        return local_table(spark, self.alias_rows(), _schema(alias_key=_S, alias_kind=_S, alias_concept_id=_I))

    def concept_table(self, spark: SparkSession) -> DataFrame:
        names = ["concept_id", "kind", "canonical", "coding_system", "coding_code", "coding_display", "category",
                 "system_group", "unit", "low", "high", "direction", "specialties", "drug_classes", "monitor_labs"]
        return local_table(
            spark, [tuple(c[n] for n in names) for c in self.concepts],
            _schema(concept_id=_I, c_kind=_S, c_canonical=_S, coding_system=_S, coding_code=_S, coding_display=_S,
                    category=_S, system_group=_S, ref_unit=_S, ref_low=_D, ref_high=_D, direction=_S,
                    specialties=_L, drug_classes=_L, monitor_labs=_L))

    def contraindication_pairs(self, spark: SparkSession) -> DataFrame:
        """One row per (rule, medication concept, condition concept): the OR in a
        rule's condition is resolved here, so data is only ever equi-joined."""
        rows = []
        for r in self.contraindications:
            for m in self.concepts:
                if m["kind"] != "medication" or r["drug_class"] not in m["drug_classes"]:
                    continue
                for c in self.concepts:
                    if c["kind"] == "condition" and (
                            (r["canonical"] and c["canonical"] == r["canonical"])
                            or (r["category"] and c["category"] == r["category"])):
                        rows.append((r["rule_no"], r["rule_id"], m["concept_id"], c["concept_id"], r["severity"],
                                     r["specialties"], r["rationale"], r["questions"]))
        return local_table(spark, rows, _schema(rule_no=_I, rule_id=_S, med_concept=_I, cond_concept=_I, severity=_S,
                                                rule_specialties=_L, rationale=_S, questions=_L))

    def interaction_pairs(self, spark: SparkSession) -> DataFrame:
        """Ordered concept pairs (a taken before b) that a rule covers in either direction."""
        rows = []
        meds = [c for c in self.concepts if c["kind"] == "medication"]
        for r in self.interactions:
            for a in meds:
                for b in meds:
                    ca, cb = a["drug_classes"], b["drug_classes"]
                    if (r["class_a"] in ca and r["class_b"] in cb) or (r["class_b"] in ca and r["class_a"] in cb):
                        rows.append((r["rule_no"], r["rule_id"], a["concept_id"], b["concept_id"], r["severity"],
                                     r["specialties"], r["rationale"], r["questions"]))
        return local_table(spark, rows, _schema(rule_no=_I, rule_id=_S, concept_a=_I, concept_b=_I, severity=_S,
                                                rule_specialties=_L, rationale=_S, questions=_L))

    def _by_canonical(self, kind: str) -> dict[str, int]:
        return {c["canonical"]: c["concept_id"] for c in self.concepts if c["kind"] == kind}

    def monitor_pairs(self, spark: SparkSession) -> DataFrame:
        labs = self._by_canonical("lab")
        rows = [(c["concept_id"], labs[lab]) for c in self.concepts for lab in c["monitor_labs"] if lab in labs]
        return local_table(spark, rows, _schema(med_concept=_I, lab_concept=_I))

    def relation_table(self, spark: SparkSession) -> DataFrame:
        """Allowed (relation, from kind, to kind) triples; ``*`` is expanded."""
        rows = []
        for relation, domain, rng, symmetric in self.relation_types:
            for f in (NODE_KINDS if "*" in domain else domain):
                for t in (NODE_KINDS if "*" in rng else rng):
                    rows.append((relation, f, t, symmetric))
        return local_table(spark, rows, _schema(relation=_S, from_kind=_S, to_kind=_S, symmetric=_B))
