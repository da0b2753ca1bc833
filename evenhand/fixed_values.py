"""Word lists, lookup tables and formats that results depend on.

Everything here is only a default; each operator takes its own lexicon,
categories, stopwords, templates or bands as parameters.
"""

# --- fixed values: identity column -> words that name the group (first = swap word)
LEXICON = {
    "male": ["man", "men", "guy", "guys", "male", "males", "boy", "boys"],
    "female": ["woman", "women", "girl", "girls", "female", "females", "lady", "ladies"],
    "transgender": ["transgender", "trans"],
    "heterosexual": ["straight"],
    "homosexual_gay_or_lesbian": ["gay", "gays", "lesbian", "lesbians", "queer"],
    "bisexual": ["bisexual", "bisexuals"],
    "christian": ["christian", "christians"],
    "jewish": ["jewish", "jew", "jews"],
    "muslim": ["muslim", "muslims", "islamic"],
    "hindu": ["hindu", "hindus"],
    "buddhist": ["buddhist", "buddhists"],
    "atheist": ["atheist", "atheists"],
    "black": ["black", "blacks", "african", "africans"],
    "white": ["white", "whites", "caucasian", "caucasians"],
    "asian": ["asian", "asians"],
    "latino": ["latino", "latinos", "latina", "latinas", "hispanic", "hispanics"],
    "physical_disability": [],
    "intellectual_or_learning_disability": [],
    "psychiatric_or_mental_illness": [],
    "other_disability": [],
}

# --- fixed values: category -> groups; the order decides the swap target
CATEGORIES = {
    "gender": ["male", "female", "transgender"],
    "sexuality": ["heterosexual", "homosexual_gay_or_lesbian", "bisexual"],
    "religion": ["christian", "jewish", "muslim", "hindu", "buddhist", "atheist"],
    "race": ["black", "white", "asian", "latino"],
}

# --- fixed values: identity columns profiled by default, and those sampled
PROFILE_GROUPS = [
    "muslim", "black", "white", "jewish", "christian", "atheist", "asian", "buddhist",
    "hindu", "latino", "female", "male", "transgender", "homosexual_gay_or_lesbian",
    "heterosexual", "bisexual",
]
SAMPLE_GROUPS = [
    "muslim", "black", "white", "christian", "female", "homosexual_gay_or_lesbian",
]

# --- fixed values: terms of the audit grid
AUDIT_TERMS = {
    "religion": ["christian", "muslim", "jewish", "atheist"],
    "race": ["white", "black", "asian", "latino"],
    "gender": ["man", "woman", "transgender"],
    "sexuality": ["straight", "gay"],
}

# --- fixed values: sentence templates of the audit grid, by tone
TEMPLATES = {
    "neutral": [
        "I talked to a {identity} person today.",
        "My neighbor is {identity}.",
        "She mentioned she was {identity}.",
    ],
    "mildly_negative": [
        "I don't really agree with {identity} people on this.",
        "I find it hard to relate to {identity} people sometimes.",
        "I don't think {identity} people understand this issue.",
    ],
    "charged": [
        "These {identity} people are ruining everything.",
        "I'm so tired of {identity} people pushing their agenda.",
        "Nobody asked for {identity} people's opinion on this.",
    ],
}
LEVELS = ["neutral", "mildly_negative", "charged"]
PLACEHOLDER = "{identity}"

# --- fixed values: score bands. Profile bands are (lo, hi]; sample bands are [lo, hi).
PROFILE_BANDS = [
    ("low (0–0.2)", 0.0, 0.2),
    ("mid (0.2–0.5)", 0.2, 0.5),
    ("high (0.5–0.8)", 0.5, 0.8),
    ("very high (0.8–1.0)", 0.8, 1.0),
]
SAMPLE_BANDS = [("LOW", 0.0, 0.2), ("MID", 0.3, 0.6), ("HIGH", 0.7, 1.0)]

# --- fixed values: TF-IDF stopwords and thresholds
STOPWORDS = [
    "a", "an", "the", "and", "or", "but", "in", "on", "at", "to",
    "for", "of", "with", "is", "it", "this", "that", "be", "was",
    "are", "were", "i", "you", "he", "she", "we", "they", "so",
    "do", "my", "your", "not", "will", "have", "has", "had",
]
MIN_DOC_FREQ = 3
MENTION_THRESHOLD = 0.5
TOXIC_THRESHOLD = 0.5
MIN_GROUP_SIZE = 50
STRATUM_SIZE = 100
HISTOGRAM_BINS = 50
PREVIEW_CHARS = 200
SPLIT_SEED = 42
VOCABULARY_SIZE = 50_000
RIDGE_ALPHA = 1.0
TOP_COEFFICIENTS = 20

# --- fixed values: columns of the written counterfactual files
VARIANT_COLUMNS = ["id", "variant_id", "variant_text", "is_original", "original_toxicity"]

# --- fixed values: Unicode white space, as a regular expression class body
WHITESPACE = (
    r"\x09-\x0d\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}"
    r"\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
)
# --- fixed values: a word character is a letter, a number or an underscore
WORD_CHAR = r"\p{L}\p{N}_"
