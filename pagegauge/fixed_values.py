"""Word lists, weights, thresholds, patterns and formats.

Everything in this file is a constant that the results depend on.  It is kept
as plain text, in natural order, so it can be read and checked in one place.
Code elsewhere refers to these names and holds no wording of its own.
"""

# --- modules and aspects -------------------------------------------------

# Scoring module -> aspect that the module judges, in report order.
MODULE_ASPECT = {
    "factChecker": "accuracy",
    "biasDetector": "bias",
    "antiManipulation": "scams",
    "defuseRagebait": "toxicity",
    "clickUnbait": "clickbait",
}

# Aspect recorded with user feedback; antiManipulation differs from the above.
FEEDBACK_MODULE_ASPECT = {
    "factChecker": "accuracy",
    "biasDetector": "bias",
    "antiManipulation": "bias",
    "defuseRagebait": "toxicity",
    "clickUnbait": "clickbait",
}

MODULE_NAMES = {
    "adBlocker": "Ad Blocker",
    "cookieCutter": "Cookie Cutter",
    "privacyShield": "Privacy Shield",
    "clickUnbait": "Click Unbait",
    "factChecker": "Fact Checker",
    "biasDetector": "Bias Detector",
    "antiManipulation": "Anti-manipulation",
    "adRevenue": "Ad Revenue",
    "defuseRagebait": "Defuse Ragebait",
}

ASPECTS = ["accuracy", "bias", "scams", "toxicity", "clickbait"]

CONTENT_TAGS = ["advert", "article", "post", "search_result", "comment", "sidebar", "other"]

# --- scam / manipulation scorer ------------------------------------------

URGENCY_PHRASES = [
    "limited time", "act now", "expires soon", "only today", "don't miss out",
    "urgent", "immediate action required", "before it's too late", "last chance",
]
FINANCIAL_PHRASES = [
    "guaranteed returns", "risk-free investment", "get rich quick",
    "work from home", "make money fast", "no experience needed",
    "free money", "click here to claim", "you've won",
]
PERSONAL_INFO_PHRASES = [
    "enter your password", "verify your account", "confirm your identity",
    "social security number", "credit card number", "bank account",
    "send payment", "wire transfer", "gift cards",
]
SHORT_BAIT_PHRASES = ["congratulation", "your account has been", "click below"]
SUSPICIOUS_HOST_ENDINGS = [".tk", ".ml", ".ga", ".cf"]
SUSPICIOUS_DOMAIN_PARTS = ["bit.ly", "tinyurl", "short.link"]
SUSPICIOUS_LINK_PARTS = ["bit.ly", "tinyurl"]

MANIPULATION_CONFIDENCE = 0.65
MANIPULATION_EXPLANATIONS = (
    "Content appears legitimate with minimal scam indicators.",
    ("Some concerning indicators detected: ", ". Exercise caution."),
    ("Multiple scam indicators detected: ", ". High risk of fraudulent or deceptive content."),
)

# --- toxicity scorer -----------------------------------------------------
# {gap} stands for "any characters up to a line break, as few as possible".
# {b} stands for an ASCII word boundary.

PROFANITY_PATTERNS = [
    r"{b}(f\*ck|f\*\*k|damn|hell|b\*tch|sh\*t){b}",
    r"{b}(a\*s|a\*\*|cr\*p){b}",
]
HATE_PATTERNS = [
    r"{b}(all|those|them) {gap} (are|is) (stupid|idiots|worthless|trash|scum){b}",
    r"{b}(deserve|should) (die|burn|suffer){b}",
    r"{b}(race|religion|ethnicity|gender) {gap} (inferior|superior){b}",
]
HARASSMENT_PATTERNS = [
    r"{b}(kill yourself|kys|off yourself){b}",
    r"{b}(you should|you deserve) (die|suffer|hurt){b}",
    r"{b}(no one|nobody) (likes|loves|wants) (you|your){b}",
]
THREAT_PATTERNS = [
    r"{b}(i will|i'll|i'm going to) (hurt|harm|kill|attack|destroy) (you|your|them){b}",
    r"{b}(you will|you'll) (regret|pay|suffer){b}",
    r"{b}(watch out|be careful|i'm coming for){b}",
]
ATTACK_PATTERNS = [
    r"{b}(you are|you're|you) (a|an) (idiot|moron|stupid|dumb|fool){b}",
    r"{b}(shut up|go away|get lost|f\*\*k off){b}",
]
TOXICITY_CONFIDENCE = 0.6
TOXICITY_EXPLANATIONS = (
    "Content appears non-toxic and appropriate.",
    ("Some concerning language detected: ", "."),
    ("High toxicity detected: ", ". "),
)

# --- political bias scorer -----------------------------------------------

LEFT_PHRASES = ["progressive", "liberal", "democratic", "social justice", "inequality", "systemic"]
RIGHT_PHRASES = ["conservative", "republican", "traditional", "free market", "individual"]
LOADED_PHRASES = ["obviously", "clearly", "undoubtedly", "everyone knows", "no one can deny"]
BALANCE_PHRASES = ["however", "although", "on the other hand", "alternatively", "meanwhile"]
EMOTIONAL_PHRASES = [
    "outrageous", "disgusting", "appalling", "shocking", "terrible", "amazing", "incredible",
]
BIAS_CONFIDENCE = 0.6
BIAS_EXPLANATIONS = (
    "Content appears balanced and objective.",
    ("Some bias detected (", "): ", "."),
    ("Significant bias detected (", "): ", ". Content shows strong ideological slant."),
)

# --- clickbait scorer: (flag, weight, pattern) ----------------------------

CLICKBAIT_THRESHOLD = 0.4
CLICKBAIT_PATTERNS = [
    ("you_wont_believe", 0.45, r"you won'?t believe"),
    ("one_weird_trick", 0.5, r"one weird trick"),
    ("the_one_thing", 0.5, r"the one thing (you'?re|you are) doing wrong"),
    ("what_happens_next", 0.4, r"what happened next|what happens next"),
    ("authority_hate", 0.45, r"doctors hate|experts hate"),
    ("shock_promise", 0.4, r"will (shock|blow your mind|amaze)"),
    ("heres_why", 0.3, r"this is why|here'?s why you"),
    ("listicle_tease", 0.25, r"[0-9]+{s}+(reasons|ways|things|secrets|tips){b}"),
    ("viral_tease", 0.35, r"{b}(gone wrong|goes viral|you need to see){b}"),
    ("question_headline", 0.15, r"\?\z"),
]
VAGUE_TITLE_PATTERN = r"{b}(this|these|that){b}"

# --- machine-written text signals (optional scorer) ------------------------

GENERIC_PHRASES = [
    "it is important to note", "in conclusion", "it should be noted", "furthermore",
    "moreover", "additionally", "as a result", "in summary",
]
PERSONAL_PRONOUNS = ["i", "we", "my", "our", "me", "us"]
COMMON_TYPOS = ["teh", "adn", "taht", "recieve"]
TRANSITION_WORDS = ["however", "therefore", "moreover", "furthermore", "consequently"]
SPECIFIC_DETAIL_PATTERNS = [r"[0-9]{4}", r"\$[0-9]+", r"[A-Z]{2,}", r"@[A-Za-z0-9_]+", r"#[A-Za-z0-9_]+"]

# --- adverts ---------------------------------------------------------------

AD_CLASS_WORDS = ["ad", "advertisement", "advert", "sponsored", "promo", "promotion"]
AD_TEXT_WORDS = ["advertisement", "sponsored", "promoted"]

# --- claims and fact checks --------------------------------------------------

MAX_CLAIMS = 3
MIN_CLAIM_CHARS = 20
MAX_CLAIM_CHARS = 500
MIN_FACT_CHECK_TEXT = 10
# Patterns are matched without regard to case.
CLAIM_PATTERNS = [
    r"^(According to|Studies show|Research indicates|Scientists say|Experts claim|It is|This is|That is)",
    r"(is|are|was|were|does|did|has|have|will|would|can|could|should|must){s}+"
    r"(a|an|the|not|never|always|all|no|some|many|most)",
    r"(proven|fact|true|false|real|fake|hoax|scam|fraud)",
]
RATING_SCORES = {
    "false": 0.0,
    "mostly false": 0.2,
    "mixture": 0.5,
    "half true": 0.5,
    "mostly true": 0.8,
    "true": 1.0,
    "pants on fire": 0.0,
}
FACT_CHECK_EXPLANATIONS = {
    "no_source": "Google Fact Check API key not configured",
    "too_short": "Content too short to fact-check",
    "no_claims": "No verifiable claims found in content",
    "none_found": "No fact-checks found for claims in this content. Unable to verify claims independently.",
    "prefix": ("Fact-checked: Found ", " fact-check(s) "),
    "mostly_false": "indicating claims are mostly FALSE or MISLEADING. Exercise extreme caution.",
    "partially_false": "with mixed or unverified ratings. Verify claims independently.",
    "mostly_true": "indicating claims are mostly TRUE. Content appears credible.",
    "other": "for claims in this content. Review ratings carefully.",
}

# --- clickbait unravelling ----------------------------------------------------

UNBAIT_MAX_CHARS = 90
ELLIPSIS = "…"
UNBAIT_EXPLANATIONS = {
    "no_link": "Clickbait detected; no link to unravel.",
    "no_page": "Clickbait detected; destination fetch failed.",
    "no_summary": "Clickbait detected; no summary available.",
    "unbaited": "Unbaited: ",
}

# --- roll-ups --------------------------------------------------------------

SUMMARY_TEXTS = {
    "high": "Content shows significant concern signals.",
    "medium": "Content shows some concern signals.",
    "low": "Content appears relatively safe.",
}
PAGE_MODULE_CONFIDENCE = 0.8
NEUTRALISED_THRESHOLD = 0.4

# --- model replies -----------------------------------------------------------

# Score used when a reply holds neither JSON nor a "score: x" figure.
REPLY_DEFAULT_SCORE = {
    "biasDetector": 0.3,
    "antiManipulation": 0.05,
    "defuseRagebait": 0.25,
    "clickUnbait": 0.2,
}
ZERO_SHOT_LABELS = {
    "biasDetector": ["This text is politically biased", "This text is objective"],
    "antiManipulation": ["spam scam", "real content"],
    "defuseRagebait": ["This text is toxic hate speech", "This text is respectful"],
    "clickUnbait": ["withholding information to force a click", "describing the article clearly"],
}
MODEL_TEXT_CHARS = 1200

# --- settings ---------------------------------------------------------------

# Sites shipped with some modules off: (host, module).
SHIPPED_OFF = [
    ("gov.uk", "factChecker"),
    ("gov.uk", "adBlocker"),
    ("nhs.uk", "factChecker"),
    ("parliament.uk", "factChecker"),
    ("parliament.uk", "biasDetector"),
]

# --- feedback ----------------------------------------------------------------

MAX_FEEDBACK_MESSAGE = 500
FEEDBACK_ERRORS = {
    "fingerprint": "chunkFingerprint is required",
    "url": "chunkUrl is required",
    "module": "moduleId is required",
    "aspect": "aspectType is invalid",
    "applies": "applies must be a boolean",
    "message_long": "message exceeds 500 characters",
}

# --- chunk extraction ----------------------------------------------------------

MIN_CHUNK_CHARS = 100
EXCERPT_CHARS = 4000
