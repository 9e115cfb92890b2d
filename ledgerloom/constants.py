"""Thresholds, word lists, patterns and lookup tables.

Everything here must be these exact values for results to be right. Numbers are
only defaults; every operator takes them as keyword arguments.
"""

# --- fixed values: ledger limits -------------------------------------------------
MIN_YEAR = 2000
MAX_YEAR = 2026
MIN_TRANSFERS = 8
MIN_BUY_FEE = 100_000
ANALYTICS_WINDOWS = (2010, 2015, 2020)

# --- fixed values: composite score weights ----------------------------------------
COMPOSITE_WEIGHTS = {
    "median_roi": 0.25,
    "total_profit": 0.20,
    "hit_rate": 0.20,
    "value_creation": 0.15,
    "annualized_roi": 0.10,
    "profit_per_deal": 0.10,
}

# --- fixed values: status-marker club ids and dashboard leagues ---------------------
NON_REAL_CLUBS = (515, 2113, 75)
DASHBOARD_LEAGUES = ("GB1", "ES1", "IT1", "FR1", "L1", "PO1", "NL1", "A1")

# --- fixed values: plausibility limits ----------------------------------------------
MAX_FEE_EUR = 500_000_000
MAX_MARKET_VALUE_EUR = 300_000_000
MAX_ROI_PCT = 10_000.0
MIN_AGE_FOR_TRANSFER = 14

# --- fixed values: fee buckets (upper bound, label); above the last is "elite" --------
FEE_BUCKETS = (
    (100_000, "micro"),
    (500_000, "small"),
    (1_000_000, "low"),
    (5_000_000, "mid_low"),
    (10_000_000, "mid"),
    (25_000_000, "mid_high"),
    (50_000_000, "high"),
    (100_000_000, "very_high"),
)

# --- fixed values: club name prefixes, stripped in this order --------------------------
CLUB_PREFIXES = ("fc ", "f.c. ", "club ", "a.f.c. ", "sc ", "sv ", "bv ", "tsv ", "vfl ")

# --- fixed values: reserve-team patterns for movement types, tested in this order -------
RESERVE_PATTERNS = (
    r"\bu19\b", r"\bu21\b", r"\bu23\b", r"\bu18\b", r"\bu20\b",
    r"\bII$", r"\bB$", r"\bB[\s_]", r"\bReservas\b",
    r"\bYouth\b", r"\bJong\b", r"\bJunior\b",
    r"\bUtd?\s*B$", r"\bFC\s*B$",
)

# --- fixed values: wider reserve-team patterns for missing-club repair -----------------
ORPHAN_RESERVE_PATTERNS = (
    r"\bu1[4-9]\b", r"\bu2[0-3]\b", r"\bII$", r"\bB$", r"\bB[\s_]",
    r"\bReservas\b", r"\bJong\b", r"\bJunior\b", r"\bJuvenil",
    r"\bSub-?1[4-9]\b", r"\bSub-?2[0-3]\b", r"\bYouth\b",
    r"\bUtd?\s*B$", r"\bFC\s*B$", r"Next Gen",
)

# --- fixed values: names that are status markers, not clubs ------------------------------
NON_CLUB_NAMES = (
    "without club", "retired", "unknown", "career break",
    "without club a", "without club b", "career break a",
    "no club", "free agent", "unattached", "retired a",
)

# --- fixed values: fee words that mean "no fee" -------------------------------------------
NO_FEE_WORDS = (
    "-", "free transfer", "free", "loan", "end of loan", "?",
    "retired", "without club", "career break",
)

# --- fixed values: accepted date formats, tried in this order -----------------------------
DATE_FORMATS = ("MMM d, yyyy", "yyyy-M-d", "d/M/yyyy", "M/d/yyyy", "d MMM yyyy", "yyyy/M/d")
#: What a text must look like at least for each format to fit: a pattern that fails costs far more than a look at the separators.
DATE_SHAPES = (r"^[^ ]+ [^ ]+, [^ ]{4,}$", r"^[^-]{4,}-[^-]+-[^-]+$", r"^[^/]+/[^/]+/[^/]{4,}$", r"^[^/]+/[^/]+/[^/]{4,}$", r"^[^ ]+ [^ ]+ [^ ]{4,}$",
               r"^[^/]{4,}/[^/]+/[^/]+$")

# --- fixed values: text that a CSV reader treats as missing -------------------------------
CSV_MISSING = (
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND",
    "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
)

# --- fixed values: confidence thresholds ---------------------------------------------------
HIGH_CONFIDENCE = 0.90
MEDIUM_CONFIDENCE = 0.70
INSERT_THRESHOLD = 0.85

# --- fixed values: position buckets ---------------------------------------------------------
POSITION_BUCKETS = {
    "Centre-Forward": "CF", "Second Striker": "CF", "Attack": "CF",
    "Left Winger": "LW", "Left Midfield": "LW",
    "Right Winger": "RW", "Right Midfield": "RW",
    "Attacking Midfield": "AM",
    "Central Midfield": "CM", "Midfield": "CM",
    "Defensive Midfield": "DM",
    "Left-Back": "LB", "Right-Back": "RB",
    "Centre-Back": "CB", "Defender": "CB",
    "Goalkeeper": "GK",
}

# --- fixed values: one-hot vocabularies ------------------------------------------------------
POSITION_VOCAB = ("CF", "LW", "RW", "AM", "CM", "DM", "LB", "RB", "CB", "GK", "Other")
FOOT_VOCAB = ("Left", "Right", "Both")
REGION_VOCAB = ("Europe", "South America", "Africa", "Asia")
AGENT_VOCAB = ("Mega", "Active", "Small", "Solo")

# --- fixed values: citizenship regions --------------------------------------------------------
REGIONS = {
    "South America": (
        "Argentina", "Bolivia", "Brazil", "Chile", "Colombia", "Ecuador",
        "Guyana", "Paraguay", "Peru", "Suriname", "Uruguay", "Venezuela",
    ),
    "Africa": (
        "Algeria", "Angola", "Benin", "Botswana", "Burkina Faso", "Burundi",
        "Cameroon", "Cape Verde", "Central African Republic", "Chad", "Comoros",
        "Congo", "DR Congo", "Djibouti", "Egypt", "Equatorial Guinea", "Eritrea",
        "Ethiopia", "Gabon", "Gambia", "Ghana", "Guinea", "Guinea-Bissau",
        "Ivory Coast", "Kenya", "Lesotho", "Liberia", "Libya", "Madagascar",
        "Malawi", "Mali", "Mauritania", "Mauritius", "Morocco", "Mozambique",
        "Namibia", "Niger", "Nigeria", "Rwanda", "Sao Tome and Principe",
        "Senegal", "Seychelles", "Sierra Leone", "Somalia", "South Africa",
        "South Sudan", "Sudan", "Swaziland", "Tanzania", "Togo", "Tunisia",
        "Uganda", "Zambia", "Zimbabwe",
    ),
    "Asia": (
        "Afghanistan", "Armenia", "Australia", "Azerbaijan", "Bahrain",
        "Bangladesh", "Bhutan", "Brunei", "Cambodia", "China", "Cyprus",
        "East Timor", "Georgia", "India", "Indonesia", "Iran", "Iraq",
        "Israel", "Japan", "Jordan", "Kazakhstan", "Kuwait", "Kyrgyzstan",
        "Laos", "Lebanon", "Malaysia", "Maldives", "Mongolia", "Myanmar",
        "Nepal", "North Korea", "Oman", "Pakistan", "Palestine", "Philippines",
        "Qatar", "Saudi Arabia", "Singapore", "South Korea", "Sri Lanka",
        "Syria", "Taiwan", "Tajikistan", "Thailand", "Turkey", "Turkmenistan",
        "United Arab Emirates", "Uzbekistan", "Vietnam", "Yemen",
    ),
    "Europe": (
        "Albania", "Andorra", "Austria", "Belarus", "Belgium",
        "Bosnia and Herzegovina", "Bulgaria", "Croatia", "Czech Republic",
        "Denmark", "England", "Estonia", "Faroe Islands", "Finland", "France",
        "Germany", "Greece", "Hungary", "Iceland", "Italy", "Kosovo", "Latvia",
        "Liechtenstein", "Lithuania", "Luxembourg", "Malta", "Moldova", "Monaco",
        "Montenegro", "Netherlands", "North Macedonia", "Norway", "Poland",
        "Portugal", "Ireland", "Romania", "Russia", "San Marino", "Scotland",
        "Serbia", "Slovakia", "Slovenia", "Spain", "Sweden", "Switzerland",
        "Ukraine", "United Kingdom", "Vatican City", "Wales",
    ),
}

# --- fixed values: display names of domestic leagues ----------------------------------------------
DOMESTIC_LEAGUE_NAMES = {
    "GB1": "English Premier League", "ES1": "LaLiga", "IT1": "Serie A",
    "FR1": "Ligue 1", "L1": "Swiss Super League", "BE1": "Belgian Pro League",
    "NL1": "Eredivisie", "PO1": "Primeira Liga",
    "BRA1": "Campeonato Brasileiro Série A",
    "ARG1": "Argentine Primera División", "C1": "Super League Greece",
    "DK1": "Danish Superliga", "AUS1": "A-League Men", "A1": "Austrian Bundesliga",
    "NO1": "Eliteserien", "SE1": "Allsvenskan", "SC1": "Scottish Premiership",
    "TR1": "Süper Lig", "RU1": "Russian Premier Liga", "PL1": "Polish Ekstraklasa",
    "TS1": "Czech Chance Liga", "RO1": "Romanian Superliga", "KR1": "Croatian HNL",
    "SER1": "Serbian SuperLiga", "UKR1": "Ukrainian Premier League",
    "MEX1": "Liga MX", "MLS1": "Major League Soccer", "JAP1": "J1 League",
    "KRS1": "K League 1", "SA1": "Saudi Pro League", "COL1": "Liga BetPlay",
}

# --- fixed values: display names of cups and international competitions -----------------------------
CUP_NAMES = {
    "CL": "UEFA Champions League", "EL": "UEFA Europa League",
    "ECLQ": "UEFA Conference League Qualifying", "ELQ": "UEFA Europa League Qualifying",
    "CLQ": "UEFA Champions League Qualifying", "FAC": "FA Cup", "CGB": "EFL Cup",
    "CDR": "Copa del Rey", "DFB": "DFB-Pokal", "CIT": "Coppa Italia",
    "DFL": "DFL-Supercup", "FRCH": "Trophée des Champions", "BESC": "Belgian Super Cup",
    "EURO": "UEFA Euro", "FIWC": "FIFA World Cup", "COPA": "Copa América",
    "AFCN": "Africa Cup of Nations", "AFAC": "AFC Asian Cup",
    "UCOL": "UEFA Conference League", "USC": "UEFA Super Cup",
    "SUC": "Spanish Supercopa", "SCI": "Italian Supercoppa",
    "GBCS": "FA Community Shield", "POCP": "Portuguese League Cup",
    "POSU": "Portuguese Super Cup", "NLP": "KNVB Cup", "NLSC": "Johan Cruyff Shield",
    "SFA": "Scottish FA Cup", "GRP": "Greek Cup", "RUP": "Russian Cup",
    "RUSS": "Russian Super Cup", "DKP": "Danish Cup", "UKRP": "Ukrainian Cup",
    "UKRS": "Ukrainian Super Cup",
}

LEAGUE_NAMES = {**DOMESTIC_LEAGUE_NAMES, **CUP_NAMES}

# --- fixed values: two leagues that the spending report names differently ---------------------------
SPENDING_LEAGUE_NAMES = {
    **DOMESTIC_LEAGUE_NAMES,
    "GB1": "Premier League",
    "BRA1": "Brasileirão Série A",
}

# --- fixed values: league logo address --------------------------------------------------------------
LEAGUE_LOGO_BASE = "https://tmssl.akamaized.net/images/logo/medium/"

# --- fixed values: movement type labels ---------------------------------------------------------------
BADGE_LABELS = {
    "paid": "Paid", "loan": "Loan", "youth_promotion": "Youth",
    "sent_to_reserves": "Reserves", "contract_expired": "Expired",
    "retired": "Retired", "free_transfer": "Free",
}

# --- fixed values: season xG leagues -------------------------------------------------------------------
XG_LEAGUES = {"EPL": "GB1", "La_liga": "ES1", "Bundesliga": "L1", "Serie_A": "IT1", "Ligue_1": "FR1"}

# --- fixed values: shot competitions by priority ---------------------------------------------------------
SHOT_COMPETITIONS = {
    "high": (16, 55, 43, 223),
    "medium": (2, 11, 9, 7, 12, 35),
    "low": (81,),
}

# --- fixed values: letters folded when building a name slug ------------------------------------------------
SLUG_FROM = "áàäâãéèëêíìïîóòöôõúùüûçñšžđ"
SLUG_TO = "aaaaaeeeeiiiiooooouuuucnszd"
