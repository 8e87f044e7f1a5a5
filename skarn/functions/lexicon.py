"""Fixed values of the text model: dimensions, seed terms, word lists and patterns.

Larger lexicons (exemplar words, operation verbs) are parameters of the operators that use them.
"""

# The eight dimensions, in the order that breaks ties, and their labels.
DIMENSIONS = ("KO", "TE", "SF", "CR", "IC", "DE", "EW", "AI")
LABELS = ("Understanding", "Testing", "Structuring", "Relating", "Feeling", "Specializing", "Acting", "Self-Reflection")

# Seed terms by dimension.
SEEDS = {
    "KO": "generate synthesize analyze pattern knowledge information signal process extract compression".split(),
    "TE": "truth verify validate evidence test measure predict observe experiment finding".split(),
    "SF": "structure architecture hierarchy network framework connection recursive formation coupling topology".split(),
    "CR": "context relevance relationship perspective meaning significance together between moment bridge".split(),
    "IC": "purpose intention love fear grief joy presence desire hope heart".split(),
    "DE": "scientific technical philosophical computational algorithm axiom threshold emergence entropy".split(),
    "EW": "execute plan build deploy carry work create make give move".split(),
    "AI": "meta learn evolve feedback memory consciousness awareness identity adapt self".split(),
}

# Words that the vocabulary leaves out.
VOCAB_STOPWORDS = (
    "the a an and or but in on at to for of is it that this was with not are be has had have from they their you your we "
    "our his her he she which who what when how all can will been were would could should than them there"
).split()

# Words that a grounding check leaves out.
GROUNDING_STOPWORDS = (
    "the a an and or but to of in on at is are was were be been being this that these those it its as for with by from not no "
    "do does did done have has had having will would can could shall should may might must i you he she we they me him her us them "
    "my your his our their what which who whom whose so if than then there here when where how why all any some into about up out "
    "over under again more most other such only own same too very just also one two"
).split()

# Words that routing leaves out.
ROUTING_STOPWORDS = (
    "the and for you your are but with this that have was her she his him they what how why into out off over very not all can got get "
    "now one two let use its has had our from image prompt seed text full open long past same read built build close morning night live first "
    "day name today tonight thing here made work still way then back more just like about would could been were who them did does ask said say next "
    "last good real true wrote write session memory"
).split()

# Suffixes and word classes of the part-of-speech guess.
VERB_SUFFIXES = ("ing", "ed", "ize", "ise", "ify", "ate")
NOUN_SUFFIXES = ("tion", "sion", "ment", "ness", "ity", "ence", "ance", "ism", "ist", "dom", "ship", "hood")
ADJECTIVE_SUFFIXES = ("ful", "less", "ous", "ive", "able", "ible", "ical", "ial")
AUXILIARIES = "is am are was were be been being has have had having do does did will would shall should can could may might must".split()
SELF_PRONOUNS = "i me my mine myself we us our ours ourselves".split()
OTHER_PRONOUNS = "you your yours yourself he him his she her hers they them their theirs it its".split()
RELATIONAL = "with between among beside alongside toward towards against together for".split()
GRAMMAR_STOPWORDS = "the a an and or but in on at to of not no this that these those very just also too so as than".split()

# Patterns of structural signals.
STRUCTURE = {
    "list": r"(?m)(?:^|\n)[ \t\n\x0b\f\r]*[-*•][ \t\n\x0b\f\r]+",
    "numbered": r"(?m)(?:^|\n)[ \t\n\x0b\f\r]*[0-9]+[.)][ \t\n\x0b\f\r]+",
    "question": r"\?(?:[ \t\n\x0b\f\r]|$)",
    "comparison": r"(?i)\b(?:but|however|whereas|unlike|instead|rather|although|while|yet|though)\b",
    "conditional": r"(?i)\b(?:if|when|unless|suppose|assuming|whether|provided)\b",
    "sequence": r"(?i)\b(?:first|then|next|after|before|finally|step|stage)\b",
    "imperative": r"^[A-Z][a-z]+[ \t\n\x0b\f\r]+(?:the|a|this|your|my)\b",
    "self_reference": r"(?i)\b(?:I|me|my|myself)\b.*\b(?:think|feel|notice|realize|wonder|believe)\b",
    "past_self": r"(?i)\bI[ \t\n\x0b\f\r]+(?:thought|felt|noticed|realized|wondered|believed|remembered|forgot)\b",
    "exclamation": r"!(?:[ \t\n\x0b\f\r]|$)",
    "capitals": r"\b[A-Z]{2,}\b",
    "hedge": r"(?i)\b(?:maybe|perhaps|probably|possibly|might|could|seems?|apparently|somewhat|fairly)\b",
    "elaboration": r"[—–\-]{2,}|[:;][ \t\n\x0b\f\r]",
}
# Dimension, patterns counted together, weight per match, most.
SIGNALS = (
    ("SF", ("list", "numbered"), 0.1, 0.4),
    ("SF", ("sequence",), 0.05, 0.2),
    ("EW", ("sequence",), 0.05, 0.15),
    ("KO", ("question",), 0.1, 0.3),
    ("TE", ("comparison",), 0.08, 0.3),
    ("TE", ("conditional",), 0.07, 0.2),
    ("EW", ("imperative",), 0.15, 0.15),
    ("AI", ("self_reference",), 0.1, 0.3),
    ("AI", ("past_self",), 0.08, 0.2),
    ("IC", ("exclamation", "capitals"), 0.05, 0.15),
    ("KO", ("elaboration",), 0.03, 0.1),
    ("AI", ("hedge",), 0.05, 0.15),
)

# Directed weights between dimensions.
ADJACENCY = {
    ("IC", "EW"): 0.8, ("IC", "CR"): 0.8, ("CR", "EW"): 0.7, ("KO", "TE"): 0.7, ("KO", "CR"): 0.6, ("KO", "EW"): 0.5,
    ("EW", "SF"): 0.7, ("EW", "CR"): 0.6, ("AI", "IC"): 0.6, ("AI", "KO"): 0.7, ("TE", "SF"): 0.6, ("TE", "KO"): 0.6,
    ("SF", "EW"): 0.5, ("DE", "KO"): 0.5, ("DE", "TE"): 0.5, ("IC", "AI"): 0.5,
}

# Patterns that mark a turn as worth keeping.
DOCTRINE = (r"\bnew rule\b", r"\bfrom now on\b", r"\b(don'?t|always|never)\b", r"§[A-Z][A-Z\.]+", r"\bdoctrine\b", r"\bcanon\b")

# Words that mark how something is said.
MODIFIERS = {
    "depth": "because although whereas while since therefore however moreover furthermore specifically particularly essentially".split(),
    "scope": "and or also both either neither various many several multiple all".split(),
    "focus": "specifically exactly precisely only particular certain specific this that".split(),
    "flex": "maybe perhaps possibly might could probably somewhat rather quite seems apparently roughly approximately".split(),
}

# Operations that speak of themselves.
SELF_OPERATIONS = ("meta", "reflect", "adapt", "evolv", "comp", "learn")

# Basins that passages are drawn to: weights of dimensions, chains that sign them.
BASINS = {
    "SELF": ({"IC": 0.4, "AI": 0.3, "CR": 0.2}, ("AI>IC", "IC>AI")),
    "OTHERS": ({"CR": 0.5, "IC": 0.3, "EW": 0.1}, ("CR>IC", "IC>CR")),
    "MAKING": ({"EW": 0.4, "KO": 0.2, "SF": 0.2}, ("EW>KO", "KO>EW")),
    "UNDERSTANDING": ({"KO": 0.3, "TE": 0.3, "SF": 0.2}, ("KO>TE", "TE>KO")),
    "WANTING": ({"IC": 0.4, "EW": 0.3, "DE": 0.1}, ("IC>EW", "EW>IC")),
}
