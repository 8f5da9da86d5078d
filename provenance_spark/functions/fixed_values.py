"""Fixed values that must equal the public libraries the original pipeline called.

Everything in this module is data, not logic. Lists are given in their published order.
Larger character classes (digits, whitespace) are built from a rule in ``text.py`` instead.
"""

# --- fixed values: ASCII punctuation, the 32 characters of Python's ``string.punctuation`` ---
ASCII_PUNCTUATION = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"

# --- fixed values: default ``filters`` of the Keras text tokenizer (apostrophe is not in it) ---
KERAS_FILTERS = "!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~\t\n"

# --- fixed values: NLTK English stop-word list (179 words, published order) ---
NLTK_ENGLISH_STOPWORDS = (
    "i", "me", "my", "myself", "we", "our", "ours", "ourselves", "you", "you're", "you've", "you'll",
    "you'd", "your", "yours", "yourself", "yourselves", "he", "him", "his", "himself", "she", "she's",
    "her", "hers", "herself", "it", "it's", "its", "itself", "they", "them", "their", "theirs",
    "themselves", "what", "which", "who", "whom", "this", "that", "that'll", "these", "those", "am",
    "is", "are", "was", "were", "be", "been", "being", "have", "has", "had", "having", "do", "does",
    "did", "doing", "a", "an", "the", "and", "but", "if", "or", "because", "as", "until", "while",
    "of", "at", "by", "for", "with", "about", "against", "between", "into", "through", "during",
    "before", "after", "above", "below", "to", "from", "up", "down", "in", "out", "on", "off", "over",
    "under", "again", "further", "then", "once", "here", "there", "when", "where", "why", "how", "all",
    "any", "both", "each", "few", "more", "most", "other", "some", "such", "no", "nor", "not", "only",
    "own", "same", "so", "than", "too", "very", "s", "t", "can", "will", "just", "don", "don't",
    "should", "should've", "now", "d", "ll", "m", "o", "re", "ve", "y", "ain", "aren", "aren't",
    "couldn", "couldn't", "didn", "didn't", "doesn", "doesn't", "hadn", "hadn't", "hasn", "hasn't",
    "haven", "haven't", "isn", "isn't", "ma", "mightn", "mightn't", "mustn", "mustn't", "needn",
    "needn't", "shan", "shan't", "shouldn", "shouldn't", "wasn", "wasn't", "weren", "weren't", "won",
    "won't", "wouldn", "wouldn't",
)

# --- fixed values: Treebank word-tokenizer contractions that survive punctuation removal ---
# Each word is split into the two parts shown (case-insensitive, whole word only).
TREEBANK_SPLIT_WORDS = (
    ("cannot", "can", "not"),
    ("gimme", "gim", "me"),
    ("gonna", "gon", "na"),
    ("gotta", "got", "ta"),
    ("lemme", "lem", "me"),
    ("wanna", "wan", "na"),
)

# --- fixed values: lemmatisation passes, in the order they are applied ---
LEMMA_POS_ORDER = ("v", "n", "a", "r", "s")

# --- fixed values: special token ids of the whole-word / word-piece encoder ---
PAD_ID, UNK_ID, CLS_ID, SEP_ID = 0, 1, 2, 3
FIRST_WORD_ID = 4
CONTINUATION_PREFIX = "##"

# --- fixed values: class strings of the scoring output and the decision threshold ---
AI_CLASS = "AI written"
HUMAN_CLASS = "not AI written"
DECISION_THRESHOLD = 0.5

# --- fixed values: the stratum mix of a prepared split (parts of 8): human, gpt2, gpt3, gpt3.5 ---
VERSION_PARTS = (("human", 4), ("gpt2", 1), ("gpt3", 1), ("gpt3.5", 2))
PARTS_TOTAL = 8

# --- fixed values: classifier-head search grids of the original pipeline ---
LR_C_GRID = (2.0, 4.0, 8.0, 16.0, 32.0)
TFIDF_LR_C_GRID = (8.0, 16.0, 32.0)
RIDGE_ALPHA_GRID = (0.03, 0.035, 0.04, 0.045)
SVC_C_GRID = (0.5, 1.0, 2.0)
FOREST_TREES = (200, 400, 600, 800, 1000)
FOREST_DEPTHS = (10, 20, 30)
SGD_LOSSES = ("hinge", "log_loss", "modified_huber", "squared_hinge", "perceptron")

# Quotation marks beyond ASCII that a word tokenizer sets apart (fixed values).
QUOTE_MARKS = ("«", "“", "‘", "„", "»", "”", "’")
