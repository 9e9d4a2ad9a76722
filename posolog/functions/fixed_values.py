"""Fixed values.

Every value in this module must equal the published behaviour of the dosing
method for the results to be right: recognised words, text patterns, potency
factors, unit codes, default thresholds and category labels.  They are data,
stated plainly and in their natural order; the logic that uses them lives in
the other modules.
"""

# ---------------------------------------------------------------- numbers ---
NUMBER = r"\d+(?:\.\d+)?"

# ------------------------------------------------- prescription text: words ---
# Spelled-out numbers and Spanish terms, and what each becomes.
WORD_REPLACEMENTS = [
    (r"\bone\b", "1"),
    (r"\btwo\b", "2"),
    (r"\bthree\b", "3"),
    (r"\bfour\b", "4"),
    (r"\bfive\b", "5"),
    (r"\bsix\b", "6"),
    (r"\bseven\b", "7"),
    (r"\beight\b", "8"),
    (r"\bnine\b", "9"),
    (r"\bten\b", "10"),
    (r"\buno\b", "1"),
    (r"\bdos\b", "2"),
    (r"\btres\b", "3"),
    (r"\bcuatro\b", "4"),
    (r"\bcinco\b", "5"),
    (r"\bseis\b", "6"),
    (r"\bsiete\b", "7"),
    (r"\bdiez\b", "10"),
    (r"\btabletas?\b", "tablet"),
    (r"\bdiario\b", "daily"),
    (r"\bpor\s+via\b", "by route"),
]
# A parenthetical without a digit and without mg/mcg is a spoken remark.
WORD_ONLY_PARENTHETICAL = r"\s*\((?![^)]*(?:mg|mcg|\d))[^)]+\)"

# ------------------------------------------- prescription text: frequencies ---
EVERY_N_HOURS = r"every\s*(\d+(?:\.\d+)?)\s*hours?|\bq(\d+(?:\.\d+)?)h\b"
TWICE_DAILY = r"twice\s*(?:daily|a\s*day|per\s*day)"
N_TIMES_DAILY = r"(\d+(?:\.\d+)?)\s*(?:times?|x)\s*(?:a\s*|per\s*)?(?:daily|day)"
FOUR_DAILY = r"\bqid\b"
THREE_DAILY = r"\btid\b"
TWO_DAILY = r"\bbid\b"
ONCE_DAILY = (
    r"once\s*(?:daily|a\s*day)|\bqd\b|\bdaily\b|every\s*day|every\s*morning|"
    r"with\s*breakfast|q\s*am\b|\bqam\b|every\s*24\s*hours?"
)
ALTERNATE_DAYS = r"every\s*other\s*day|\bqod\b|alternate\s*day"
EVERY_N_DAYS = r"every\s*(\d+(?:\.\d+)?)\s*days?|\bq(\d+(?:\.\d+)?)d\b"
TWICE_WEEKLY = r"twice\s*(?:a\s*)?week|twice\s*weekly"
N_TIMES_WEEKLY = r"(\d+(?:\.\d+)?)\s*(?:times?|x)\s*(?:a\s*|per\s*)?week"
EVERY_N_WEEKS = r"every\s*(\d+(?:\.\d+)?)\s*weeks?"
ONCE_WEEKLY = r"once\s*(?:a\s*)?week|once\s*weekly|\bqweek\b|\bq7d\b|\bweekly\b"
ONCE_MONTHLY = (
    r"once\s*(?:a\s*)?month|\bmonthly\b|\bq30d\b|every\s*30\s*days?|every\s*month"
)
ONCE_ORAL = r"\bonce\b.*\boral\b"
NIGHTLY = r"\bnightly\b|every\s*evening"
MORNING = r"\bin\s+(?:the\s+)?(?:am\b|morning)|every\s+(?:am\b|morning)|each\s+morning"
ONCE_FOR_DOSES = r"\bonce\b.*\bfor\s+\d+\s+doses?"
ONLY_MG = r"^\d+(?:\.\d+)?\s*mg\.?$"
BY_MOUTH = r"(?:by\s+mouth|\bpo\b|\borally\b)"
NOT_A_DAILY_INTAKE = r"\bhours?\b|\bhrs?\b|\bbefore\b|\bafter\b|procedure|surgery"
PER_DAY = r"\ba\s+day\b|\bper\s+day\b|\bper\s+d\b"

# ------------------------------------------------ prescription text: amounts ---
TABLET_UNIT = r"(?:tablets?|tabs?|pills?|capsules?|caps?)"
TABLETS = r"(\d+(?:\.\d+)?)\s*(?:tablets?|tabs?|pills?|capsules?|caps?)"
WORD_NUMBERS = {
    "half": 0.5,
    "one": 1.0,
    "a": 1.0,
    "an": 1.0,
    "two": 2.0,
    "three": 3.0,
    "four": 4.0,
    "five": 5.0,
    "six": 6.0,
}
N_AND_A_HALF = r"(\d+(?:\.\d+)?)\s+and\s+(?:a\s+)?half\s+" + TABLET_UNIT
N_OR_FRACTION = "(\\d+(?:\\.\\d+)?|1/2|½)\\s*" + TABLET_UNIT
WORD_AND_A_HALF = (
    r"\b(one|two|three|four|five|six|half|a|an)\s+and\s+(?:a\s+)?half\s+" + TABLET_UNIT
)
WORD_TABLETS = r"\b(one|two|three|four|five|six|half|a|an)\s*" + TABLET_UNIT

DURATION = (
    r"(?:for|x)\s*(\d+(?:\.\d+)?)\s*(day|days|wk|wks|week|weeks|mo|mos|month|months)"
)
DAYS_PER_WEEK = 7.0
DAYS_PER_MONTH = 30.0

MG_TOTAL = r"\((\d+(?:\.\d+)?)\s*mg\s*total\)"
MG_PER_DOSE = r"\((\d+(?:\.\d+)?)\s*mg\s*per\s*dose\)"
MG_PARENTHESISED = r"\((\d+(?:\.\d+)?)\s*mg\)"
MG_PER_DAY = r"(?<!\()\b(\d+(?:\.\d+)?)\s*mg\s*(?:/\s*day|per\s*day|a\s*day)\b"
MG_BARE = r"(?<!\()\b(\d+(?:\.\d+)?)\s*mg\b"
MG_IN_NAME = r"(\d+(?:\.\d+)?)\s*mg"

DAILY_WORD = (
    r"daily|every day|once daily|\bqd\b|with breakfast|every morning|qam|every 24 hours?"
)
PRN_WORD = r"\bprn\b|as needed|when needed|if needed"
FREE_TEXT_WORD = (
    r"as directed|use as directed|see attach|per md|per ng|per physician|"
    r"per doctor|per provider"
)
TAPER_WORD = (
    r"taper|decreas|reducing|reduce by|\bdrop\b|\bthen\b.*\bmg\b|"
    r"\bthen\b.*\btabs?\b|alternate day|\bqod\b|every other day"
)

# ------------------------------------------------- prescription text: tapers ---
TAPER_GATE_WORD = r"then|taper|decreas|reduce|drop"
TAPER_MG_MENTION = r"\d+(?:\.\d+)?\s*mg"
TAPER_SEPARATOR = r",?\s+then\s+|\s*;\s*|,\s*(?=\d+(?:\.\d+)?\s*mg)"
TAPER_STEP = (
    r"(\d+(?:\.\d+)?)\s*mg(?:/day|/d(?:ay)?)?[^.!?;]{0,50}?\b(?:for|x)\b\s*"
    r"(\d+(?:\.\d+)?)\s*(days?|wks?|weeks?|mos?|months?)"
)
TAPER_PER_DOSE = r"per\s*dose|each\s*dose"
TAPER_START = (
    r"(?:^\s*|(?:start(?:ing)?|begin(?:ning)?|continue)\s+(?:at\s+)?)(\d+(?:\.\d+)?)\s*mg"
)
TAPER_DECREMENT = (
    r"(?:decrease|decreas|reduce|taper|drop)\s+(?:\w+\s+){0,2}(?:by\s+)?"
    r"(\d+(?:\.\d+)?)\s*mg\s+(?:each|every|per)\s*(\d+)?\s*"
    r"(days?|wks?|weeks?|mos?|months?)"
)

# ------------------------------------------------------------- drug names ---
PREDNISOLONE_WORD = r"\bprednisolone\b"
METHYL_WORD = "methyl"
# First match wins; prednisolone without "methyl" is tested before these.
DRUG_NAME_PATTERNS = [
    (r"methylpred|methyl prednisolone|medrol|solu-medrol|solumedrol", "methylprednisolone"),
    (r"\bprednisone\b|rayos|sterapred", "prednisone"),
    (r"dexamethasone|decadron|dexasone", "dexamethasone"),
    (r"hydrocortisone|cortef|solu-cortef", "hydrocortisone"),
    (r"triamcinolone|kenalog|aristospan", "triamcinolone"),
    (r"budesonide|entocort|uceris|pulmicort", "budesonide"),
]

# ----------------------------------------------------------------- routes ---
# First match wins; a text that matches none is "other".
ROUTE_PATTERNS = [
    (
        "inhaled",
        r"inhal|metered|aerosol|dry powder|actuat|nebul|pulmicort|diskus|turbuhaler|"
        r"flexhaler|ellipta|respimat|twisthaler|rotadisk|rotahaler|autohaler|evohaler|"
        r"handihaler|pressurized|\binh\b|\bmdi\b",
    ),
    ("ophthalmic", r"ophthalm|eye|ocular|otic|ear"),
    ("topical", r"topical|cream|ointment|lotion|gel|patch|transdermal|rectal|nasal"),
    (
        "injection",
        r"inject|intraven|intramus|\bim\b|\biv\b|\bsq\b|subcutan|\bsc\b|intraartic|"
        r"intradermal|epidural|infusion|\binjec\b|intrathecal|intraperiton|intravitreal|"
        r"intraocular|\binj\b|for\s+(?:injection|infusion)|\bvial\b",
    ),
    (
        "oral",
        r"\boral\b|mouth|sublingual|buccal|swallow|\btab\b|tablet|capsule|"
        r"oral\s+(?:solution|liquid|suspension|syrup|elixir|drop)",
    ),
]

# -------------------------------------------------------- potency factors ---
# mg prednisone per mg of the drug; budesonide is known but has no factor.
PREDNISONE_FACTORS = {
    "prednisone": 1.0,
    "prednisolone": 1.0,
    "methylprednisolone": 1.25,
    "dexamethasone": 7.5,
    "hydrocortisone": 0.25,
    "triamcinolone": 1.25,
    "budesonide": None,
}

# ----------------------------------------------------- codes and defaults ---
MG_UNIT_CONCEPTS = (0, 8576)  # "no matching concept" and milligram
MAX_DAILY_DOSE_MG = 2000.0
GAP_DAYS = 30
DAY_AGREEMENT_MG = 10.0
HIGH_ERROR_MG = 10.0
HIGH_ERROR_PCT = 50.0
LIMITS_OF_AGREEMENT_Z = 1.96
FIRST_START_DATE = "1900-01-01"

DOSE_METHODS = ("original", "tablets_freq", "actual_duration", "supply_based")
DOSE_BREAKS = (0.0, 10.0, 20.0, 40.0, float("inf"))
DOSE_LABELS = ("Low (<=10mg)", "Medium (10-20mg)", "High (20-40mg)", "Very High (>40mg)")
AGREEMENT_CATEGORIES = (
    (5.0, "Exact (<=5%)"),
    (20.0, "Good (<=20%)"),
    (50.0, "Moderate (<=50%)"),
    (None, "Poor (>50%)"),
)

DATE_FORMATS = ("yyyy-M-d", "M/d/yyyy", "yyyyMMdd", "yyyy/M/d")

# Default date and concept columns of the clinical event tables.
EVENT_COLUMNS = {
    "condition_occurrence": ("condition_start_date", "condition_concept_id"),
    "drug_exposure": ("drug_exposure_start_date", "drug_concept_id"),
    "measurement": ("measurement_date", "measurement_concept_id"),
    "observation": ("observation_date", "observation_concept_id"),
    "visit_occurrence": ("visit_start_date", "visit_concept_id"),
    "procedure_occurrence": ("procedure_date", "procedure_concept_id"),
}
OTHER_EVENT_COLUMNS = ("start_date", "concept_id")
