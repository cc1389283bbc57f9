"""Study specifications: the declarative constants every operator is driven by.

A ``StudySpec`` carries the field roles (X / Z / Y, strata, enumerated fields),
the option lists that define each field's code domain (code = position), the
alias tables used to fold free-text answers into codes, the inclusion criteria,
the binarisation thresholds and the published target effect.  Operators read a
spec; nothing below is executed here.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from typing import Callable, Optional

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class StudySpec:
    name: str
    x: tuple                      # covariate fields (X)
    y: str                        # outcome field
    z: str                        # treatment field
    strata: tuple                 # stratification fields (hybrid estimators)
    enum: tuple                   # enumerated X fields (full-joint estimators)
    options: dict                 # field -> ordered option labels (code = position)
    questions: dict = field(default_factory=dict)
    aliases: dict = field(default_factory=dict)        # field -> {label: code}, extra folds
    decode_labels: dict = field(default_factory=dict)   # field -> labels by code, where not the options (C7)
    allowed_treatments: tuple = ()                      # B15 allow-list (raw answers)
    treatment_folds: dict = field(default_factory=dict)  # code -> raw answers (C9)
    yes_no_fields: tuple = ()                           # fields coded No=0 / Yes=1 in discretize
    numeric_fields: tuple = ()                          # lenient numeric parse (C10)
    thresholds: dict = field(default_factory=dict)      # field -> t; x <= t -> 0, x > t -> 1 (C13)
    outcome_threshold: Optional[float] = None           # pct <= t -> target (C12)
    outcome_known: Optional[Callable[[], Column]] = None  # B15 outcome-known predicate
    criteria: Optional[Callable[[], list]] = None       # B16 criteria (NULL counts as pass)
    criteria_drop: tuple = ()                           # columns dropped after B16
    lexicon: tuple = ()                                 # treatment terms (B10)
    outcome_words: tuple = ()                           # outcome terms (B11)
    descriptions: dict = field(default_factory=dict)    # C5 attribute descriptions
    description_sep: str = ". \n"
    ground_truth: Optional[float] = None
    uncorrected_ground_truth: Optional[float] = None
    confounder: Optional[str] = None
    confounder_propensity: Optional[float] = None
    subreddits: tuple = ()

    def roles(self, enum: bool = False, strata: bool = False) -> list:
        """Role projection -- X (or the enumerated / stratification fields), Z, Y."""
        xs = list(self.enum if enum else self.strata if strata else self.x)
        return xs + [self.z, self.y]

    def select_roles(self, df, enum: bool = False, strata: bool = False, extra=()):
        return df.select(*extra, *[c for c in self.roles(enum, strata) if c in df.columns])

    def domain(self, f: str) -> list:
        return list(self.options[f])

    def shape(self, fields) -> list:
        return [len(self.options[f]) for f in fields]


def _c(name):
    return F.col(name)


# --------------------------------------------------------------------------------------
# Option lists, questions, aliases, allow-lists, lexicons, thresholds and
# target effects that must equal the published study definitions for equal results.
# --------------------------------------------------------------------------------------

EMAIL = StudySpec(
    name="email_marketing",
    x=("recency", "history", "mens", "womens", "zip_code", "newbie", "channel"),
    y="visit",
    z="email_type",
    strata=("recency", "history", "mens", "womens", "zip_code", "newbie", "channel"),
    enum=("womens", "newbie"),
    options={
        "recency": ["1 - 4", "5 - 8", "9 - 12"],
        "history": ["0 - 100", "100 - 200", "200 - 350", "350 - 500", "500 - 750", "750 - 1000", "1000 +"],
        "mens": ["No", "Yes"],
        "womens": ["No", "Yes"],
        "zip_code": ["Suburban area", "Rural area", "Urban area"],
        "newbie": ["No", "Yes"],
        "channel": ["Phone", "Web", "Multichannel"],
        "email_type": ["No", "Yes"],
        "visit": ["No", "Yes"],
    },
    questions={
        "recency": "How many months has it been since the user's last purchase?",
        "history": "What range does the dollar value spent by the user previously lie in?",
        "mens": "Did the user purchase men's merchandise?",
        "womens": "Did the user purchase women's merchandise?",
        "zip_code": "Which area does the user's zipcode lie in?",
        "newbie": "Was the user was a newbie, or a new customer, in the past one year?",
        "channel": "What channel did the user use to make their previous purchase?",
        "email_type": "Did the user mention receiving a marketing email?",
        "visit": "Did the user visit the website recently?",
    },
    # labels the discretiser folds (answers arrive without the " area" suffix)
    aliases={"zip_code": {"Suburban": 0, "Rural": 1, "Urban": 2}},
    descriptions={
        "recency": "The number of months since your last purchase: ",
        "history": "The dollar value you spent in the past one year is: ",
        "mens": "Your previous purchase was of men's merchandise: ",
        "womens": "Your previous purchase was of women's merchandise: ",
        "zip_code": "Whether you live in an Urban, Suburban or Rural area: ",
        "newbie": "You became a new customer in the past one year: ",
        "channel": "Whether you made your purchase in the past one year using a Phone, the Web or Multiple channels: ",
        "email_type": "You received a marketing e-mail about women's or men's merchandise: ",
        "visit": "You visited the website again recently: ",
    },
    description_sep=". \n",
    ground_truth=0.060865,
    uncorrected_ground_truth=0.023771,
    confounder="newbie",
    confounder_propensity=0.3,
)

# history (dollars) right-closed ladder -> code 0..6 and recency (months) -> 0..2
EMAIL_HISTORY_EDGES = [100, 200, 350, 500, 750, 1000]
EMAIL_RECENCY_EDGES = [4, 8]
# trial-table recodes
EMAIL_HISTORY_SEGMENTS = ["1) $0 - $100", "2) $100 - $200", "3) $200 - $350", "4) $350 - $500",
                          "5) $500 - $750", "6) $750 - $1000"]  # anything else -> 6
EMAIL_ZIP_RECODE = {"Suburban": 0, "Rural": 1}                  # anything else -> 2
EMAIL_CHANNEL_RECODE = {"Phone": 0, "Web": 1}                   # anything else -> 2
EMAIL_TREATMENT_RECODE = {"Womens E-Mail": 0, "Mens E-Mail": 1, "No E-Mail": 2}
EMAIL_TREATMENT_BINARY = {"Womens E-Mail": 1, "No E-Mail": 0, "Mens E-Mail": 1}

RETAIL = StudySpec(
    name="retail_sms",
    x=("avg_purchase", "avg_product_quantity", "num_transactions", "age", "avg_regular_points_received"),
    y="purchase",
    z="sms_communication",
    strata=("age_binary", "avg_purchase", "avg_product_quantity", "num_transactions", "avg_regular_points_received"),
    enum=("avg_regular_points_received", "age_binary"),
    options={
        "avg_purchase": ["1 - 263", "264 - 396", "397 - 611", "612 - 7694"],
        "avg_product_quantity": ["No", "Yes"],
        "avg_regular_points_received": ["No", "Yes"],
        "num_transactions": ["1 - 8", "9 - 15", "16 - 27", "28 - 320"],
        "age_binary": ["No", "Yes"],
        "sms_communication": ["No", "Yes"],
        "purchase": ["No", "Yes"],
    },
    questions={
        "avg_purchase": "In what interval does the user's average purchase per transaction lie?",
        "avg_product_quantity": "Did the user purchase more than 7 products on average?",
        "avg_regular_points_received": "Has the user received more than 5 regular points on average?",
        "num_transactions": "In what interval does the user's number of transactions so far lie?",
        "age_binary": "Is the user's age greater than 45 years?",
        "sms_communication": "Did the user mention receiving marketing communication via SMS from the retailer?",
        "purchase": "Did the user mention a recent purchase from the retailer?",
    },
    descriptions={
        "avg_purchase": "The average dollar value you have spent per transaction: ",
        "avg_product_quantity": "The rough number of products you tend to purchase in each transaction: ",
        "avg_regular_points_received": "Average number of regular points you have received on a transaction: ",
        "num_transactions": "Total number of transactions you have made so far: ",
        "age": "Mention your age, in years, which is: ",
        "sms_communication": "You received marketing communication via SMS from the retailer - true or false: ",
        "purchase": "You made another purchase from the retailer recently - true or false: ",
    },
    description_sep=". \n ",
    ground_truth=0.033217,
    uncorrected_ground_truth=0.015295,
    confounder="age_binary",
    confounder_propensity=0.7,
)

# right-closed bin edges (lo, hi] -> bin index (C14)
RETAIL_BINS = {
    "avg_purchase": [0, 263, 396, 611, 7694.1],
    "avg_product_quantity": [-0.1, 7, 120.1],
    "num_transactions": [0, 8, 15, 27, 320.1],
    "avg_regular_points_received": [-0.1, 5, 205],
}
RETAIL_AGE_THRESHOLD = 45

_LIRA_TERMS = (
    "ozempic", "saxenda", "semaglutide", "liraglutide", "wegovy", "rybelsus", "victoza",
    "ozempci", "ozmepic", "ozepmic", "ozempik", "ozemipic", "ozenpic", "osemepic", "ozemepic", "ozeempic", "ozempec",
    "sexenda", "saxanda", "saxeeda", "sacxenda", "sxenda", "saxend", "sxaenda", "saxendaa", "saxeden",
    "semaglutid", "semaglutied", "seamaglutide", "semaglutde", "semagluide", "semagltuide", "semaglutidde", "semaglutite", "smeaglutide", "semagulitde",
    "liragutide", "liraglute", "liarglutide", "liragultide", "leraglutide", "liragludite", "liraglitide", "liraglutid", "liraglutade", "liragluetide",
    "wegovi", "wegov", "wegoyv", "wegvo", "wegovy", "wegovy", "wegovuy", "wegoy", "wegovoy", "wegovy",
    "ryblesus", "rybelsu", "rybeslus", "rybelus", "rybelsuss", "rybelsis", "rybelssus", "rybelssu", "rybelus", "ryblessus",
    "victoz", "vicotza", "victosa", "victoaz", "victoa", "victza", "victosa", "vicotza", "victzoa", "victzo",
    "ozenpic", "osempic", "ozempik", "saxend", "semaglitude", "semagluteid", "liraglutid",
    "wegovi", "wegoby", "rybelsis", "ribelsus", "rybelzus", "victoz",
)
_TIRZ_TERMS = (
    "ozempic", "mounjaro", "semaglutide", "tirzepatide", "wegovy", "rybelsus", "zepbound",
    "ozempci", "ozmepic", "ozepmic", "ozempik", "ozemipic", "ozenpic", "osemepic", "ozemepic", "ozeempic", "ozempec",
    "mounjrao", "mounajro", "mounjrao", "monujaro", "mounajro", "mounjoro", "munjaro", "mounjro", "mounjra", "mounjao",
    "semaglutid", "semaglutied", "seamaglutide", "semaglutde", "semagluide", "semagltuide", "semaglutidde", "semaglutite", "smeaglutide", "semagulitde",
    "tirzepatid", "tirzepatied", "tirzepatde", "trizepatide", "tirzepaitde", "tirzepatidde", "tirzeptatide", "tirzepatidde", "tirzepatdie", "tirzapetide",
    "wegovi", "wegov", "wegoyv", "wegvo", "wegovy", "wegovy", "wegovuy", "wegoy", "wegovoy", "wegovy",
    "ryblesus", "rybelsu", "rybeslus", "rybelus", "rybelsuss", "rybelsis", "rybelssus", "rybelssu", "rybelus", "ryblessus",
    "zepbund", "zepboud", "zepbonud", "zepbuond", "zepboun", "zepbund", "zepobund", "zepboudn", "zepboud", "zepbounnd",
    "ozenpic", "osempic", "ozempik", "mounjero", "mounjrao", "semaglitude", "semagluteid", "tirzepatid",
    "wegovi", "wegoby", "rybelsis", "ribelsus", "rybelzus", "zepbund", "zepboud", "zepboun",
)
_WEIGHT_WORDS = ("kg", "kilo", "lb", "pound", "weigh", "drop", "loss", "lost", "gain", "hb", "a1c", "hemoglobin",
                 "haemoglobin", "glucose", "sugar")
_TOPIRAMATE_TERMS = (
    "topiramte", "topiramat", "topriamate", "topiramaet", "topiramtae", "topiramet", "topirameat", "topiramatte", "topiramae", "topiramaet",
    "topamx", "topamxa", "topamaz", "topamxa", "topmax", "topamaz", "topamx", "toapmax", "topama", "topamxx",
    "epitomxa", "epitmoax", "epiotmax", "epitomaz", "epitoma", "epitmoax", "epiotomax", "epitomaxx", "epitomxa", "epitomaz",
    "topirgan", "topiragn", "topirgaen", "topirgne", "topiraegn", "topirgen", "topiragn", "topirgaen", "topirgane", "topiargen",
    "epronita", "eprontai", "epronti", "epronita", "epronita", "epronia", "eprontai", "eprontiaa", "epronti", "epronta",
    "qudxy", "qudex", "quedxy", "qudexy", "qudxey", "quedexy", "qudexxy", "quedyx", "qudex", "qudxey",
    "troknedi", "troekndi", "trokenid", "troekndi", "troknedi", "trokend", "trokindi", "trokedni", "trkendi", "trokenid",
)
_TOPIRAMATE_TERMS_2 = (
    "topromate", "topirimate", "topiramat", "topomax", "epitomaks", "epitomix", "topiragin", "topiragun", "topiragin",
    "epronia", "eprontea", "qudexi", "qudexie", "qudexey", "trokendy", "trokendie", "trokendii",
)
# The published botox list has a missing comma that fuses two terms into one
# ("onabotulnumtoxinabotex"); kept literally so matches equal the published run.
_BOTOX_TERMS = (
    "onabotulinumtoxin", "botox", "topiramate", "topamax", "topimax", "epitomax", "topiragen", "eprontia", "qudexy", "trokendi",
    "botulinum", "onabotulimuntoxin", "onabotulinumtoxan", "onabotulinymtoxina", "onabotulimuntoxina", "onabotulinmtoxina",
    "onabotulinumtxina", "onabotulintmoxina", "onabotulinumtaxin", "onabotulnumtoxinabotex",
    "boto", "bottox", "botx", "botoks", "botoxx", "botto", "bottocks", "botoxz", "botoxs",
) + _TOPIRAMATE_TERMS + _TOPIRAMATE_TERMS_2
_ERENUMAB_TERMS = (
    "erenumab", "aimovig", "topiramate", "topamax", "topimax", "epitomax", "topiragen", "eprontia", "qudexy", "trokendi",
    "erenumaba", "erenumabb", "erenuma", "erunumab", "erenumb", "erenmuab", "erenumb", "erenamub", "erenumaab", "erenubam",
    "aimoivg", "aomovig", "aimovgi", "aimoivg", "amiovig", "aimvoig", "aimovg", "aiomvig", "aimovgi", "aimoigv",
) + _TOPIRAMATE_TERMS + ("erenumb", "erenamab", "erenomab", "amovig", "aimovik") + _TOPIRAMATE_TERMS_2
# "MMD" is listed upper-case and can never match lower-cased text; we lower-case it.
_MIGRAINE_WORDS = ("stop", "continue", "adverse", "side", "effect", "nausea", "aura", "pound", "tolerate", "quit",
                   "scotoma", "visual", "light", "sound", "eye", "constipation", "muscle spasm", "reaction", "fatigue",
                   "drowsy", "allergic", "cognitive", "memory", "nausea", "weight", "kidney", "days", "mmd")

_GLP1_X = ("age", "sex", "country", "t2dm", "metformin", "bmi", "start_HbA1c", "end_HbA1c", "start_weight",
           "end_weight", "weight_unit", "weight_change", "percentage_weight_change", "duration_days", "dosage")
_GLP1_NUMERIC = ("age", "sex", "country", "bmi", "start_HbA1c", "end_HbA1c", "start_weight", "end_weight",
                 "weight_change", "percentage_weight_change", "duration_days", "dosage")
_GLP1_STRATA = ("age", "sex", "bmi", "start_HbA1c", "start_weight", "duration_days")


def _in_range(c, lo, hi):
    return (F.col(c) >= lo) & (F.col(c) <= hi)


def _lira_criteria():
    t2dm = ((_c("t2dm") == 1) | _c("t2dm").isNull()) & (_in_range("start_HbA1c", 7, 10.5) | _c("start_HbA1c").isNull())
    metformin = (_c("metformin") == 1) | _c("metformin").isNull()
    dosage = (((_c("drug_type") == 0) & (_c("dosage") == 1)) | ((_c("drug_type") == 1) & (_c("dosage") == 1.2))
              | _c("dosage").isNull())
    return [t2dm, metformin, dosage]


def _tirz_criteria():
    t2dm = ((_c("t2dm") == 1) | _c("t2dm").isNull()) & (_in_range("start_HbA1c", 7, 10.5) | _c("start_HbA1c").isNull())
    metformin = (_c("metformin") == 1) | _c("metformin").isNull()
    bmi = (_c("bmi") >= 25) | _c("bmi").isNull()
    dosage = (((_c("drug_type") == 0) & (_c("dosage") == 1)) | ((_c("drug_type") == 1) & (_c("dosage") == 5))
              | _c("dosage").isNull())
    return [t2dm, metformin, bmi, dosage]


# The published age rule is ">= 18 OR <= 65", true for every age; kept literally.
AGE_RULE = (18, 65)


def _age_rule():
    lo, hi = AGE_RULE
    return (_c("age") >= lo) | (_c("age") <= hi) | _c("age").isNull()


def _botox_criteria():
    mmd = _in_range("baseline_MMD", 15, 30) | _c("baseline_MMD").isNull()
    dosage = (_c("drug_type") == 0) | ((_c("drug_type") == 1) & (_c("dosage") <= 100)) | _c("dosage").isNull()
    return [mmd, dosage, _age_rule()]


def _erenumab_criteria():
    pregnant = (_c("pregnant") == 0) | _c("pregnant").isNull()
    mmd = _in_range("baseline_MMD", 4, 30) | _c("baseline_MMD").isNull()
    dosage = (((_c("drug_type") == 0) & ((_c("dosage") == 70) | (_c("dosage") == 140)))
              | ((_c("drug_type") == 1) & (_c("dosage") <= 100)) | _c("dosage").isNull())
    return [_age_rule(), pregnant, mmd, dosage]


def _weight_known_lira():
    return _c("start_weight").isNotNull() & (_c("end_weight").isNotNull() | _c("weight_change").isNotNull()
                                              | _c("percentage_weight_change").isNotNull())


def _weight_known_tirz():
    return (_c("end_weight").isNotNull() | _c("weight_change").isNotNull()
            | _c("percentage_weight_change").isNotNull())


def _discontinued_known():
    return _c("discontinued").isNotNull()


_SEX = {"sex": {"Male": 0, "Female": 1}}

LIRAGLUTIDE = StudySpec(
    name="liraglutide",
    x=_GLP1_X, y="target_achieved", z="drug_type", strata=_GLP1_STRATA, enum=_GLP1_STRATA,
    options={
        "age": ["No", "Yes"], "sex": ["Male", "Female"],
        "country": ["United States", "Mexico", "Canada", "Australia", "United Kingdom", "Belgium", "Greece",
                    "Germany", "Brazil", "Netherlands", "Colombia", "Denmark", "Finland", "Middle East", "Norway",
                    "Serbia"],
        "bmi": ["No", "Yes"], "start_HbA1c": ["No", "Yes"], "start_weight": ["No", "Yes"],
        "duration_days": ["Upto 120 days", "Over 120 days"],
        "drug_type": ["Semaglutide like Ozempic or Wegovy or Rybelsus", "Liraglutide like Saxenda or Victoza"],
        "target_achieved": ["No", "Yes"],
    },
    questions={
        "age": "Is the user's age greater than 45 years?",
        "sex": "What is the reported sex of the user?",
        "t2dm": "Does the user have Type 2 Diabetes?",
        "metformin": "Does the user mention taking Metformin or other background medication?",
        "bmi": "Is the user's Body Mass Index (BMI) greater than 28.5 kg per meter squared?",
        "start_HbA1c": "Is the user's starting HbA1c level before treatment greater than 7.5%?",
        "start_weight": "Is the user's starting weight level before treatment greater than 220 lbs?",
        "end_HbA1c": "What is the user's final HbA1c level at the end of their treatment regime?",
        "end_weight": "What is the user's final weight at the end of their treatment regime, in lb?",
        "weight_unit": "What units was the user's weight originally reported in?",
        "weight_change": "What is the net change in the user's weight, in lb?",
        "percentage_weight_change": "What is the percentage change in the user's weight?",
        "duration_days": "For what duration did the user take the treatment, before reporting change in their weight?",
        "dosage": "What was the dosage of the treatment taken by the user, in mg?",
        "drug_type": "Which treatment did the user take?",
        "target_achieved": "Did the user lose 10 or more percent of their initial weight?",
    },
    aliases={**_SEX, "country": {"United States": 0, "USA": 0, "Mexico": 1, "Canada": 2, "Australia": 3,
                                 "United Kingdom": 4, "UK": 4, "Belgium": 5, "Greece": 6, "Germany": 7, "Brazil": 8,
                                 "Netherlands": 9, "Colombia": 10, "Denmark": 11, "Finland": 12, "Middle East": 13,
                                 "Norway": 14, "Serbia": 15}},
    allowed_treatments=("Semaglutide", "Wegovy", "Liraglutide", "Ozempic (Semaglutide)", "Ozempic", "Rybelsus",
                        "Saxenda (Liraglutide)", "Wegovy/Ozempic", "Wegovy/Semaglutide", "Saxenda",
                        "Wegovy or Ozempic (Semaglutide)", "Victoza", "Wegovy/Ozempic (Semaglutide)",
                        "Wegovy (Same drug as Ozempic)", "Ozempic/Wegovy (Semaglutide)", "Wegovy (Semaglutide)",
                        "Saxenda or Victoza", "Ozempic/Wegovy", "WeGovy", "Rybelsus (Semaglutide)",
                        "Wegovy 2.4 (Semaglutide)", "Rybelsus 14 mg", "Wegovy - Semaglutide"),
    treatment_folds={0: ["Ozempic", "Wegovy", "Rybelsus", "Semaglutide"], 1: ["Victoza", "Saxenda", "Liraglutide"]},
    yes_no_fields=("t2dm", "metformin"),
    numeric_fields=_GLP1_NUMERIC,
    thresholds={"age": 45, "bmi": 28.5, "start_HbA1c": 7.5, "start_weight": 220, "duration_days": 120},
    outcome_threshold=-10,
    outcome_known=_weight_known_lira,
    criteria=_lira_criteria,
    criteria_drop=("t2dm", "metformin", "dosage"),
    lexicon=_LIRA_TERMS,
    outcome_words=_WEIGHT_WORDS,
    ground_truth=(4.4 - 19.1) / 100,
    subreddits=("liraglutide",),
)

TIRZEPATIDE = StudySpec(
    name="tirzepatide",
    x=_GLP1_X, y="target_achieved", z="drug_type", strata=_GLP1_STRATA, enum=_GLP1_STRATA,
    options={
        "age": ["No", "Yes"], "sex": ["Male", "Female"],
        "country": ["United States", "Mexico", "Canada", "Australia", "United Kingdom", "Belgium", "Greece",
                    "Germany", "Brazil", "Costa Rica", "Italy"],
        "bmi": ["No", "Yes"], "start_HbA1c": ["No", "Yes"], "start_weight": ["No", "Yes"],
        "duration_days": ["Upto 90 days", "Over 90 days"],
        "drug_type": ["Semaglutide like Ozempic or Wegovy or Rybelsus", "Tirzepatide like Mounjaro or Zepbound"],
        "target_achieved": ["No", "Yes"],
    },
    questions={
        "age": "Is the user's age greater than 45 years?",
        "sex": "What is the reported sex of the user?",
        "country": "Which country does the user reside in?",
        "t2dm": "Does the user have Type 2 Diabetes?",
        "metformin": "Does the user mention taking Metformin?",
        "bmi": "Is the user's Body Mass Index (BMI) greater than 28.5 kg per meter squared?",
        "start_HbA1c": "Is the user's starting HbA1c level before treatment greater than 7.5%?",
        "start_weight": "Is the user's starting weight level before treatment greater than 220 lbs?",
        "end_HbA1c": "What is the user's final HbA1c level at the end of their treatment regime?",
        "end_weight": "What is the user's final weight at the end of their treatment regime, in lb?",
        "weight_unit": "What units was the user's weight originally reported in?",
        "weight_change": "What is the net change in the user's weight, in lb?",
        "percentage_weight_change": "What is the percentage change in the user's weight?",
        "duration_days": "For what duration did the user take the treatment, before reporting change in their weight?",
        "dosage": "What was the dosage of the treatment taken by the user, in mg?",
        "drug_type": "Which treatment did the user take?",
        "target_achieved": "Did the user lose 5 or more percent of their initial weight?",
    },
    aliases={**_SEX, "country": {"United States": 0, "Mexico": 1, "Canada": 2, "Australia": 3, "United Kingdom": 4,
                                 "UK": 4, "Belgium": 5, "Greece": 6, "Germany": 7, "Brazil": 8, "Costa Rica": 9,
                                 "Italy": 10}},
    allowed_treatments=("Tirzepatide", "Semaglutide", "Mounjaro", "Ozempic", "Wegovy", "Zepbound", "Rybelsus",
                        "Wegovy (Semaglutide)", "Semaglutide (Rybelsus)", "Wegovy/Semaglutide", "Wegovy - Semaglutide",
                        "GLP-1 agonist medications (Semaglutide)", "Mounjaro (Tirzepatide)", "Ozempic (Semaglutide)",
                        "Mounjaro or Zepbound", "Semaglutide (Ozempic)", "Rybelsus (Semaglutide)",
                        "Ozempic/Wegovy (Semaglutide)", "Wegovy/Ozempic", "Wegovy / Ozempic",
                        "Mix of Semaglutide (Wegovy) and Ozempic", "Mixed (Wegovy and Ozempic)", "Ozempic/Wegovy",
                        "Wegovy or Ozempic (Semaglutide)", "Wegovy or Ozempic", "Wegovy (under the Ozempic brand)",
                        "Wegovy and Ozempic", "Wegovy/Ozempic (Semaglutide)"),
    treatment_folds={0: ["Ozempic", "Wegovy", "Rybelsus", "Semaglutide", "Ozempic / Wegovy", "Metformin and Ozempic"],
                     1: ["Mounjaro", "Zepbound", "Tirzepatide", "Trizepatide", "Munjaro", "Mounjourno"]},
    yes_no_fields=("t2dm", "metformin"),
    numeric_fields=_GLP1_NUMERIC,
    thresholds={"age": 45, "bmi": 28.5, "start_HbA1c": 7.5, "start_weight": 220, "duration_days": 90},
    outcome_threshold=-5,
    outcome_known=_weight_known_tirz,
    criteria=_tirz_criteria,
    criteria_drop=("t2dm", "metformin", "dosage"),
    lexicon=_TIRZ_TERMS,
    outcome_words=_WEIGHT_WORDS,
    ground_truth=(68.55 - 58.44) / 100,
    subreddits=("Mounjaro", "Ozempic", "fasting", "intermittentfasting", "keto", "loseit", "Semaglutide",
                "SuperMorbidlyObese", "PlusSize"),
)

_MIGRAINE_STRATA = ("age", "sex", "country", "baseline_MMD", "duration_days")

BOTOX = StudySpec(
    name="botox",
    x=("age", "sex", "country", "baseline_MMD", "final_MMD", "duration_days", "dosage", "adverse_effect"),
    y="discontinued", z="drug_type", strata=_MIGRAINE_STRATA, enum=_MIGRAINE_STRATA,
    options={
        "age": ["No", "Yes"], "sex": ["Male", "Female"],
        "country": ["United States", "Canada", "Australia", "Europe", "UK", "Germany", "Argentina", "Scotland",
                    "Brazil"],
        "baseline_MMD": ["No", "Yes"], "duration_days": ["Upto 30 days", "Over 30 days"],
        "drug_type": ["Botox injection", "Topiramate"], "discontinued": ["No", "Yes"],
    },
    questions={
        "age": "Is the user's age greater than 25 years?",
        "sex": "What is the reported sex of the user?",
        "country": "Which country does the user reside in?",
        "baseline_MMD": "Did the user experience migraine symptoms for greater than 15 days per month, before starting treatment?",
        "duration_days": "For what duration did the user take the treatment, before reporting their experience?",
        "drug_type": "Which treatment did the user take?",
        "discontinued": "Did the user discontinue the treatment above due to adverse side effects?",
    },
    decode_labels={"country": ["United States", "Canada", "Australia", "Europe", "United Kingdom", "Germany",
                               "Argentina", "Scotland", "Brazil"]},
    aliases={**_SEX, "country": {"United States": 0, "US": 0, "USA": 0, "Ohio": 0, "California": 0, "PNW": 0,
                                 "British Columbia, Canada": 1, "Canada": 1, "Australia": 2, "Europe": 3, "EU": 3,
                                 "UK": 4, "United Kingdom": 4, "Germany": 5, "Argentina": 6, "Scotland": 7,
                                 "Brazil": 8}},
    allowed_treatments=("Topiramate", "Topiragen", "Topamax", "Topomax", "Topimax", "Trokendi", "Trokenidi",
                        "Topirimate", "Qudexy", "Topiramat", "Botox"),
    treatment_folds={0: ["Botox"], 1: ["Topiramate", "Topiragen", "Topamax", "Topomax", "Topimax", "Trokendi",
                                       "Topirimate", "Qudexy", "Topiramat"]},
    yes_no_fields=("discontinued",),
    numeric_fields=("age", "sex", "country", "baseline_MMD", "final_MMD", "duration_days", "dosage"),
    thresholds={"age": 25, "baseline_MMD": 15, "duration_days": 30},
    outcome_known=_discontinued_known,
    criteria=_botox_criteria,
    criteria_drop=("dosage",),
    lexicon=_BOTOX_TERMS,
    outcome_words=_MIGRAINE_WORDS,
    ground_truth=(42 - 1) / 100,
    subreddits=("migraine",),
)

ERENUMAB = StudySpec(
    name="erenumab",
    x=("age", "onset_age", "sex", "country", "pregnant", "baseline_MMD", "final_MMD", "duration_days", "dosage",
       "adverse_effect"),
    y="discontinued", z="drug_type", strata=_MIGRAINE_STRATA, enum=_MIGRAINE_STRATA,
    options={
        "age": ["No", "Yes"], "sex": ["Male", "Female"],
        "country": ["United States", "Canada", "Australia", "Europe", "UK", "Germany", "Argentina", "Scotland",
                    "Brazil", "Chile", "Norway", "Denmark"],
        "baseline_MMD": ["No", "Yes"], "duration_days": ["Upto 30 days", "Over 30 days"],
        "drug_type": ["Erenumab like Aimovig", "Topiramate like Topiragen or Topamax or Trokendi or Qudexy"],
        "discontinued": ["No", "Yes"],
    },
    questions={
        "age": "Is the user's age greater than 32 years?",
        "sex": "What is the reported sex of the user?",
        "country": "Which country does the user reside in?",
        "baseline_MMD": "Did the user experience migraine symptoms for greater than 6 days per month, before starting treatment?",
        "duration_days": "For what duration did the user take the treatment, before reporting their experience?",
        "drug_type": "Which treatment did the user take?",
        "discontinued": "Did the user discontinue treatment due to adverse side effects?",
    },
    decode_labels={"country": ["United States", "Canada", "Australia", "Europe", "United Kingdom", "Germany",
                               "Argentina", "Scotland", "Brazil", "Chile", "Norway", "Denmark"]},
    aliases={**_SEX, "country": {"United States": 0, "US": 0, "USA": 0, "Texas": 0, "PNW": 0, "Canada": 1,
                                 "Australia": 2, "Europe": 3, "EU": 3, "UK": 4, "United Kingdom": 4, "Germany": 5,
                                 "Argentina": 6, "Scotland": 7, "Brazil": 8, "Chile": 9, "Norway": 10,
                                 "Denmark": 11}},
    allowed_treatments=("Topiramate", "Topiragen", "Topamax", "Topamax XR", "Topomax", "Topimax", "Trokendi",
                        "Trokenidi", "Topirimate", "Qudexy", "Topiramat", "Erenumab", "Aimovig",
                        "CGRP inhibitor (Erenumab)", "CGRP (Erenumab)", "CGRPs (Erenumab)", "CGRPs (Erenumab)"),
    treatment_folds={0: ["Erenumab", "Aimovig", "CGRP inhibitor (Erenumab)", "CGRP (Erenumab)", "CGRPs (Erenumab)"],
                     1: ["Topiramate", "Topiragen", "Topamax", "Topamax XR", "Topomax", "Topimax", "Trokendi",
                         "Topirimate", "Qudexy", "Topiramat"]},
    yes_no_fields=("pregnant", "discontinued"),
    numeric_fields=("age", "sex", "country", "baseline_MMD", "final_MMD", "duration_days", "dosage"),
    thresholds={"age": 32, "baseline_MMD": 6, "duration_days": 30},
    outcome_known=_discontinued_known,
    criteria=_erenumab_criteria,
    criteria_drop=("pregnant", "dosage"),
    lexicon=_ERENUMAB_TERMS,
    outcome_words=_MIGRAINE_WORDS,
    ground_truth=(38.9 - 10.6) / 100,
    subreddits=("migraine",),
)

KG_TO_LB = 2.20462
UNKNOWN_MARKERS = ("Unknown", "unknown")

STUDIES = {s.name: s for s in (EMAIL, RETAIL, LIRAGLUTIDE, TIRZEPATIDE, BOTOX, ERENUMAB)}
CLINICAL = ("liraglutide", "tirzepatide", "botox", "erenumab")
