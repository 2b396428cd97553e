"""Fixed values.

Patterns, word lists, labels, formats and constants that must be exactly as
they are for results to come out right. They are parameters of the operators
(the defaults), never buried in a plan.
"""

# --- Masks: token -> pattern, in the order in which they are applied --------
EMAIL_PATTERN = r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}\b"
PHONE_PATTERN = r"\b(?:\+?\d{1,3}[-.\s]?)?\(?\d{3}\)?[-.\s]?\d{3}[-.\s]?\d{4}\b"
CARD_PATTERN = r"\b(?:\d[ -]*?){13,16}\b"
WALLET_PATTERN = r"\b(0x[a-fA-F0-9]{40}|[13][a-km-zA-HJ-NP-Z1-9]{25,34})\b"
URL_PATTERN = r"https?://\S+|www\.\S+"
IP_PATTERN = r"\b\d{1,3}(?:\.\d{1,3}){3}\b"

EMAIL_TOKEN = "<EMAIL>"
PHONE_TOKEN = "<PHONE>"
CARD_TOKEN = "<CARD_NUMBER>"
WALLET_TOKEN = "<CRYPTO_WALLET>"
URL_TOKEN = "<URL>"
IP_TOKEN = "<IP_ADDRESS>"

MASK_TOKENS = [EMAIL_TOKEN, PHONE_TOKEN, CARD_TOKEN, WALLET_TOKEN, URL_TOKEN, IP_TOKEN]

# Unicode whitespace.
WHITESPACE_CHARACTERS = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f\x20\x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)
# What a word character is, inside a class: any letter, any number, underscore.
WORD = r"\p{L}\p{N}_"

# --- Label sets -------------------------------------------------------------
SEVEN_CLASSES = [
    "online_financial_fraud",
    "phishing_smishing",
    "cyber_harassment_blackmail",
    "cyber_threat_intelligence",
    "ecommerce_fraud",
    "sextortion",
    "identity_threat",
]
SIX_CLASSES = [
    "identity_theft_impersonation",
    "financial_cyber_fraud",
    "phishing_social_engineering",
    "ransomware_extortion",
    "unauthorized_access_hacking",
    "denial_of_service_disruption",
]
DEFAULT_CLASS = "online_financial_fraud"

# --- Keyword rules: (category, patterns), the first category that hits wins ---
KEYWORD_RULES = [
    ("online_financial_fraud", [
        r"\bwire fraud\b",
        r"\bcrypto(?:currency)? scam\b",
        r"\bunauthorized (?:wire|transfer|transaction)\b",
        r"\binvestment fraud\b",
        r"\badvance fee\b",
        r"\b419 scheme\b",
        r"\bescrow\b",
    ]),
    ("phishing_smishing", [
        r"\bphishing\b",
        r"\bsmishing\b",
        r"\bspoofed (?:email|link|site)\b",
        r"\bpackage delivery\b",
        r"\bcredential harvest\b",
        r"\bverify your (?:card|password)\b",
    ]),
    ("cyber_harassment_blackmail", [
        r"\bharassment\b",
        r"\bstalking\b",
        r"\bdoxx(?:ed|ing)\b",
        r"\bthreat(?:en|ening)?\b",
        r"\bdefamat(?:ory|ion)\b",
        r"\bswatting\b",
        r"\bhate speech\b",
    ]),
    ("cyber_threat_intelligence", [
        r"\bcve-\d{4}-\d+\b",
        r"\bzero-day\b",
        r"\bddos\b",
        r"\bransomware c2\b",
        r"\bmalware signature\b",
        r"\bthreat actor\b",
        r"\bexfiltration\b",
    ]),
    ("ecommerce_fraud", [
        r"\bonline purchase\b",
        r"\bmerchant dispute\b",
        r"\bnever delivered\b",
        r"\bcounterfeit\b",
        r"\bfake store\b",
        r"\bdeceptive shopping\b",
    ]),
    ("sextortion", [
        r"\bsextortion\b",
        r"\bwebcam (?:video|recording)\b",
        r"\bintimate (?:video|photo)\b",
        r"\bblackmail\b",
        r"\brecorded you\b",
        r"\bdual-screen\b",
    ]),
    ("identity_threat", [
        r"\bidentity theft\b",
        r"\bstolen ssn\b",
        r"\bopened without (?:my )?consent\b",
        r"\bsynthetic identity\b",
        r"\bcompromised credentials\b",
        r"\bdata breach\b",
    ]),
]

# --- Standard record columns ------------------------------------------------
CORPUS_COLUMNS = [
    "complaint_id", "source", "primary_category", "raw_text", "cleaned_text", "word_count",
]
AGENCY_COLUMNS = [
    "complaint_id", "source", "date_received", "product",
    "raw_text", "cleaned_text", "primary_category", "original_issue",
]

# Literals of the agency adapter.
AGENCY_SOURCE = "custom_agency"
AGENCY_PRODUCT = "Institutional Complaint"
AGENCY_DATE = "2024-06-01"
AGENCY_ISSUE = "Custom Agency Report"
AGENCY_ID_PREFIX = "custom_"

# --- Labelled loaders: id prefix, source literal, category ---------------------
SMS_SPAM = ("uci_sms_", "UCI SMS Spam Collection (spam label)", "phishing_smishing")
HATE_SPEECH = (
    "davidson_", "Davidson Hate Speech & Threat Corpus", "cyber_harassment_blackmail",
)
FRAUD_MAIL = ("clair_", "CLAIR Fraud Email Corpus", "online_financial_fraud")
HATE_SPEECH_CLASSES = [0, 1]
HATE_SPEECH_SAMPLE = 700

# Regulator columns and routing rules: id prefix, source literal, category,
# then (column, case-insensitive pattern) pairs, any of which routes the row.
REGULATOR_TEXT = "Consumer complaint narrative"
REGULATOR_RULES = [
    ("cfpb_fraud_", "CFPB (Fraud or scam)", "online_financial_fraud",
     [("Issue", "Fraud or scam"), ("Product", "Money transfer|virtual currency")]),
    ("cfpb_id_", "CFPB (Identity theft)", "identity_threat",
     [("Issue", "Identity theft")]),
    ("cfpb_ecom_", "CFPB (E-Commerce dispute)", "ecommerce_fraud",
     [("Sub-issue", "goods or services you didn't receive")]),
]
REGULATOR_CAP = 600

# Parts of a column name that mark it as the text column, per kind of source.
TEXT_COLUMN_WORDS = {
    "fraud_mail": ["body", "text", "content"],
    "incident": ["description", "narrative"],
    "police": ["incident", "report", "narrative", "text"],
}

# --- Sizes and constants ----------------------------------------------------
SEED = 42
TARGET_PER_CLASS = 700
MIN_WORDS = 5
TRAIN_PERCENT = 70
QUERIES_PER_CLASS = 50
JUDGMENTS_PER_QUERY = 30
GRADED_QUERIES = 300
GRADED_CATEGORY_CAP = 20
TOP_UP_PREFIX, TOP_UP_START, TOP_UP_SOURCE = "gen_", 10000, "Corpus Synthesis"
BM25_K1, BM25_B = 1.5, 0.75
RRF_K, RRF_CANDIDATES = 60, 50
TFIDF_FEATURES, TFIDF_MIN_DF = 10000, 2
CLASS_TERM_FEATURES, CLASS_TERMS = 2500, 6
NB_SMOOTHING = 0.1
HISTOGRAM_BINS = 35
WORD_PERCENTILES = [50, 75, 90, 95, 99]
MIN_CORPUS_ROWS, MIN_CLASS_ROWS, EXPECTED_QUERIES, MIN_RELEVANCE = 4000, 500, 350, 1

# --- English stop words (the default; any other list can be passed) ---------
STOP_WORDS = """
i me my myself we our ours ourselves you your yours yourself yourselves he him
his himself she her hers herself it its itself they them their theirs
themselves what which who whom this that these those am is are was were be
been being have has had having do does did doing a an the and but if or
because as until while of at by for with about against between into through
during before after above below to from up down in out on off over under
again further then once here there when where why how all any both each few
more most other some such no nor not only own same so than too very s t can
will just don should now
""".split()
