"""Fixed values of the retrieval, routing and evaluation formulas, and the sample lexicon."""

# Words that filter tokens leave out.
STOP_WORDS = """a an the and or but not is are was were be been being do does did have has had i me my we our you your he she it
they to of in for on with at by from up about into through during until against among when where who which what that this these
those can will just should would could use used using may how why if than so as such also""".split()
# Quantifiers that query normalisation drops.
NOISE_WORDS = "many much often several various certain few some any every all most more".split()
# Single words that are too general to be a query's phrase.
SINGLE_WORD_STOPS = """provider providers policy policies rule rules requirement requirements information info details general specific covered coverage
applies apply process guideline guidelines service services plan plans member members patient patients client clients notice section program programs
benefit benefits criteria procedure procedures standard standards update updates""".split()
# Words without information in a query, untagged words that are too general to select by, words of titles that don't count.
QUERY_NOISE = """a an the is are was were be been being of for to in on at by from with without and or but if then than as so such what which who whom whose
where when why how do does did can could would should will shall tell show give find explain describe summarize say says said saying cover covers covered
across applies apply applying me us you i we they them my our your this that these those about regarding policy policies rule rules requirement
requirements information info details guideline guidelines general specific applicable current process new old recent now today""".split()
GENERIC_UNTAGGED = """provider providers policy policies rule rules requirement requirements information info details general specific covered coverage
applies apply process guideline guidelines service services plan plans member members patient patients client clients""".split()
TITLE_STOPS = "the a an of for and or in on to with from by at is are this that".split()
# Words that candidates may not consist of alone, phrases that are never proposed, abbreviations that aren't any.
CANDIDATE_STOPS = """is are was were be been being have has had do does did will would could should may might must shall can the a an and or but if then else
when what which who whom whose where why how that this these those it its as at by for with to from of in on into through during before after above below
between under again further each both few more most other some such no not only own same so than too very just also please thank you we they our your
their""".split()
COMMON_PHRASES = (
    "thank you", "please contact", "as follows", "for more information", "in order to", "prior to", "in accordance with", "with respect to", "due to",
    "as well as", "such as", "as of", "in addition to", "in the event", "as required", "as applicable", "if applicable", "as needed", "at least",
    "at the time", "a copy of", "a member", "a provider", "a copy", "and provider", "and providers", "and services", "are required", "are required to",
    "in order", "of the", "to the", "for the", "with the", "access to", "accordance with", "along with", "and appeals", "and behavioral",
    "and behavioral health",
)
COMMON_ABBREVIATIONS = """i ii iii iv v vi vii viii ix x id pdf url faq usa etc inc llc ltd tel fax www http https org com gov edu""".split()
# Weight of an authority level, its tier, and the default.
AUTHORITY = {"contract_source_of_truth": 1.0, "payer_website": 0.75, "operational_suggested": 0.65, "payer_policy": 0.50, "fyi_not_citable": 0.20}
AUTHORITY_DEFAULT = 0.10
TIER = {"contract_source_of_truth": 0, "payer_policy": 1, "operational_suggested": 1, "fyi_not_citable": 2}
TIER_DEFAULT = 3
# Field weight of body text, fusion constant, decay share, d-tag boost.
FIELD_WEIGHT = {"A": 1.0, "B": 0.4, "C": 0.2, "D": 0.1}
RRF_K = 60
NEIGHBOUR_SHARE, NEIGHBOUR_FLOOR = 0.5, 0.15
DECAY = 0.6
TAG_BOOST = 1.5
RERANK = {"sim": 0.25, "auth": 0.10, "len": 0.05, "jpd": 0.20, "cov": 0.55}
CONFIDENCE = (("high", 0.55), ("medium", 0.35), ("low", 0.18))
# Tag propagation and headings.
LINE_WEIGHT, PARAGRAPH_WEIGHT, DOCUMENT_WEIGHT, HEADING_WEIGHT = 1.0, 0.3, 0.1, 2
# Router.
LINEAR_BASE = {"a": 0.40, "b": 0.20, "c": 0.05, "d": 0.20}
LINEAR_WEIGHTS = {
    "a": {"exclusivity": 0.30, "literal": 0.25, "corpus_depth": 0.20, "thematic_policy": -0.10, "wide_pool": -0.15, "inheritance": 0.05},
    "b": {"thematic_policy": 0.40, "corpus_depth": 0.20, "literal": -0.20, "exclusivity": 0.05},
    "c": {},
    "d": {"crawlability": 0.40, "wide_pool": 0.25, "inheritance": -0.25, "thematic_policy": -0.20, "corpus_depth": -0.15, "literal": -0.05},
}
LINEAR_WEIGHTS_2 = {
    "a": {"exclusivity": 0.30, "literal": 0.25, "depth_x_excl": 0.05, "tag_coverage": 0.15, "thematic_policy": -0.10, "wide_pool": -0.15},
    "b": {"thematic_policy": 0.40, "corpus_depth": 0.20, "literal": -0.20, "exclusivity": 0.05},
    "c": {},
    "d": {"crawlability": 0.40, "wide_pool": 0.25, "inheritance": -0.25, "thematic_policy": -0.20, "corpus_depth": -0.15, "literal": -0.05},
}
CRAWLABILITY = {"sunshine": 0.80, "aetna": 0.00, "simply": 0.00, "humana": 0.40, "staywell": 0.30, "wellcare": 0.40}
# Presets of callers (answer shape, accuracy, recall, speed), weights of speed and shape, priors of a policy question.
DEFAULT_CALLER = "chat.default"
CALLER_PRESETS = {
    "chat.copilot": ("structured", 0.70, 0.70, "real_time"),
    "chat.default": ("essay", 0.85, 0.95, "real_time"),
    "chat.thinking": ("essay", 0.95, 0.95, "interactive"),
    "auth_agent": ("binary", 1.00, 0.95, "interactive"),
    "research": ("essay", 0.95, 1.00, "none"),
    "batch": ("structured", 0.90, 0.80, "background"),
}
SPEED_WEIGHTS = {"real_time": 1.0, "interactive": 0.4, "background": 0.1, "none": 0.0}
SHAPE_WEIGHT, SHAPE_MISS = 0.30, 0.4
CANONICAL_PRIORS = {
    "a": {"accuracy": 0.467, "accuracy_std": 0.125, "recall_capacity": 1.00, "recall_std": 0, "speed": 0.98},
    "b": {"accuracy": 0.508, "accuracy_std": 0.377, "recall_capacity": 0.70, "recall_std": 0, "speed": 0.75},
    "c": {"accuracy": 0.033, "accuracy_std": 0.100, "recall_capacity": 0.40, "recall_std": 0, "speed": 0.12},
    "d": {"accuracy": 0.600, "accuracy_std": 0.367, "recall_capacity": 1.00, "recall_std": 0, "speed": 0.48},
}
DAMPED = ("corpus_depth", "inheritance")
WITHDRAW, GAP, FLOOR = 0.05, 0.08, 0.30
# Selectivity bounds, gate, composite weights, correct threshold.
REQUIRED, BOOSTED = 0.65, 0.40
BROAD_MIN_DOCS = 25
COMPOSITE = {"recall": 0.45, "precision": 0.30, "speed": 0.25}
CORRECT = 0.67
# Phrase precision and generic words.
NOISY_DF, NOISY_P, RARE_DF, CANONICAL_P = 100, 0.60, 5, 0.85
GENERIC_REJECTED, GENERIC_LEXICON = 30, 1

#: A lexicon in the words of the test tables: (kind, code, strong phrases, weak phrases, refuted words).
LEXICON = (
    ("d", "claims.timely_filing", ("that the", "thereof"), ("tion",), ("stupid",)),
    ("d", "claims.general", ("with",), ("from",), ()),
    ("d", "eligibility.member", ("und der", "einer"), ("mit",), ()),
    ("d", "pharmacy.formulary", ("que la", "pour le"), ("avec",), ("worthless",)),
    ("p", "authorization.prior", ("this is", "are the"), ("have",), ()),
    ("p", "appeals.filing", ("dans", "nicht"), ("oder",), ()),
    ("j", "payor.alpha", ("en la", "por el"), ("para",), ()),
    ("j", "state.fl", ("of the", "in the"), ("onto",), ()),
    ("j", "payor.beta", ("license", "token"), (), ()),
)
