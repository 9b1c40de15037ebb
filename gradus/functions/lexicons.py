"""Word lists, patterns, thresholds and weights that results depend on."""

STOP_WORDS = """
a an the is are was were be been being have has had do does did will would shall should may might must can could am it its
i me my we our you your he him his she her they them their this that these those of in to for with on at by from
as into through during before after above below between out off over under again further then once and but or nor not no so
if when which who whom what where how all each every both few more most other some such only own same than too very
just about up down here there any
""".split()

# Besides stop words, what counts as a known word where gibberish is looked for.
COMMON_WORDS = """
also back because been call come day did even find first get give go good great hand help high keep know large last let life like line long look made
make many much name need new next number old one open order part people place point right said same say set show small start state still take tell
think three time turn two use used want way well work world year data system process computer program software method function class object type value
code example different important information result problem question answer student learning define defined definition means refers concept theory
based include includes including following given called known describes description explain provides using however therefore thus hence since although
while where when which between through during other another such each every these those there here most after before above below under over specific
general particular certain various main primary major key basic simple complex structure form level step stage phase memory network database server
client user input output file table list array queue stack tree graph node edge path algorithm sort search binary linear recursive loop variable
constant parameter argument return language model test case error exception handle manage control operate perform execute create delete update read
write access public private protected static final abstract interface implement extend inherit override application service component module package
library framework platform environment tool
""".split()

# Structure of an answer; all ignore case.
INTRO = r"^(.*?\b(is defined as|refers to|is the process|is a |are the |means that|can be described|is known as|denotes|consists of|comprises)\b|(in this context|generally|broadly|fundamentally|essentially|to understand|to begin with|the concept of|the term)\b)"
CONTEXT = r"^(in computing|in biology|in physics|in chemistry|in mathematics|in software engineering|in economics|in the field of|according to|the term|the concept|a |an )\b"
CONCLUSION = r"\b(therefore|in conclusion|thus|hence|to conclude|in summary|to summarize|overall|consequently|as a result|to sum up|in short|finally|it can be concluded|we can conclude|this shows that|this demonstrates|this proves|this indicates)\b"
SUMMARY = r"\b(important|essential|crucial|key point|main idea|primary|significant|necessary|fundamental)\b"
NUMBERED = r"(?m)^\s*\d{1,2}[.)]\s+"
BULLETS = r"(?m)^\s*[-*•●○▪]\s+"
ROMAN = r"(?m)^\s*(i{1,3}|iv|vi{0,3}|ix|x)[.)]\s+"
LETTERED = r"(?m)^\s*[a-h][.)]\s+"
ENUMERATION = r"\b(such as|including|like|namely|e\.g\.)\s+[^.]+,\s+[^.]+"
COLON_LIST = r":\s*\n\s*[-*\d]"
DEFINITIONS = [
    r"\w\s+(is|are)\s+defined\s+as\b",
    r"\w\s+refers?\s+to\b",
    r"\w\s+(is|are)\s+(the\s+)?process\s+(of|by which)\b",
    r"\w\s+(is|are)\s+(a|an)\s+(type|kind|form|method|technique)\s+of\b",
    r"\w\s+means\s+(that|the)\b",
    r"\w\s+can\s+be\s+(defined|described|understood)\s+as\b",
    r"\w,\s*also\s+known\s+as\b",
    r"\w\s+(is|are)\s+known\s+as\b",
    r"\w\s+(is|are)\s+(a|an)\s+\w+\s+that\b",
    r"\bthe\s+term\s+['\"]?\w+['\"]?\s+(means|refers|denotes)\b",
]
EXAMPLES = r"\b(for example|for instance|e\.g\.|such as|consider the case|consider the|take for example|to illustrate|as an example|an example of|a good example|a typical example|in practice|in real life|a case in point)\b"
ANALOGIES = r"\b(similar\s+to|analogous\s+to|just\s+like|much\s+like|comparable\s+to|resembles|akin\s+to)\b"
NUMBERS = r"\b\d+(\.\d+)?(\s*%|\s*percent|\s*times|\s*years)\b"
ADDITIVE = r"\b(moreover|furthermore|in addition|additionally|also|besides|what is more|equally important)\b"
ADVERSATIVE = r"\b(however|on the other hand|nevertheless|although|despite|in contrast|whereas|but|yet|nonetheless)\b"
CAUSAL = r"\b(therefore|because|since|consequently|as a result|due to|owing to|hence|thus|so that|leads to|causes)\b"
SEQUENTIAL = r"\b(first|firstly|second|secondly|third|thirdly|next|then|finally|lastly|subsequently|meanwhile|at the same time|after that|following this)\b"
STRUCTURE_WEIGHTS = {"intro": 0.15, "body": 0.25, "conclusion": 0.10, "lists": 0.15, "definitions": 0.10, "examples": 0.10, "coherence": 0.15}
STRUCTURE_BONUS = 0.08

# What a sentence does, in the order of precedence, and how much that weighs.
ROLE_CUES = [
    ("definition", r"\b(is defined as|refers to|is the process|means that|can be defined|is known as|is called|denotes|is a |are the |consists of|comprises)\b"),
    ("example", r"\b(for example|for instance|such as|e\.g\.|consider the|like |an example|illustrat)\b"),
    ("transition", r"^(however|moreover|furthermore|in addition|on the other hand|therefore|thus|hence|in conclusion|to summarize|overall|additionally|consequently|as a result|in summary)\b"),
    ("key_fact", r"\b(must|always|never|important|critical|essential|key |primary|fundamental|significant|crucial|main |major |necessary|required)\b"),
]
ROLE_WEIGHTS = {"definition": 1.5, "key_fact": 1.5, "explanation": 1.3, "example": 0.5, "transition": 0.3, "general": 1.0}

# Padding.
FILLERS = r"\b(it is important to note that|it should be noted that|it is worth mentioning that|as we all know|as everyone knows|needless to say|it goes without saying|in today's world|in the modern world|in today's society|since the beginning of time|from time immemorial|in this day and age|at the end of the day|when all is said and done|last but not least|each and every|first and foremost|the fact that|due to the fact that|in spite of the fact that|as a matter of fact|for all intents and purposes|it can be said that|it is well known that|basically|essentially|actually|literally|very very|really really)\b"
HEDGES = r"\b(perhaps|maybe|possibly|arguably|somewhat|sort of|kind of|more or less|to some extent|in a way|in some sense|it seems|it appears)\b"

# Cognitive levels, from remember to create, and what a hit at each weighs.
LEVELS = ["Remember", "Understand", "Apply", "Analyse", "Evaluate", "Create"]
LEVEL_WEIGHTS = [1.0, 1.2, 1.4, 1.8, 2.0, 2.2]
QUESTION_CUES = [
    [r"\bdefine\b", r"\blist\b", r"\bstate\b", r"\brecall\b", r"\bname\b", r"\bidentify\b", r"\benumerate\b", r"\blabel\b", r"\brecite\b", r"\brecognize\b", r"\bmatch\b", r"\bwhat\s+is\b", r"\bwhat\s+are\b", r"\bwho\b"],
    [r"\bexplain\b", r"\bdescribe\b", r"\bsummar(?:ize|ise)\b", r"\binterpret\b", r"\bparaphrase\b", r"\billustrate\b", r"\bdiscuss\b", r"\belaborate\b", r"\bclarify\b", r"\bin\s+your\s+own\s+words\b", r"\bgive\s+(?:an?\s+)?example", r"\bwhy\b", r"\bhow\s+does\b"],
    [r"\bapply\b", r"\bdemonstrate\b", r"\bcalculate\b", r"\bsolve\b", r"\buse\b", r"\bimplement\b", r"\bshow\s+how\b", r"\bcompute\b", r"\bexecute\b", r"\bconstruct\b", r"\bperform\b", r"\boperate\b", r"\bpractice\b", r"\bexercise\b"],
    [r"\banalyse\b", r"\banalyze\b", r"\bcompare\b", r"\bcontrast\b", r"\bdifferentiat\w*\b", r"\bdistinguish\b", r"\bexamine\b", r"\binvestigat\w*\b", r"\bcategoriz\w*\b", r"\bclassify\b", r"\bdeconstruct\b", r"\bbreak\s+down\b", r"\brelate\b", r"\borganiz\w*\b", r"\bdifference\s+between\b", r"\bsimilarit(?:y|ies)\b"],
    [r"\bevaluat\w*\b", r"\bjustify\b", r"\bjudge\b", r"\bcritiqu\w*\b", r"\bcritical(?:ly)?\b", r"\bassess\b", r"\bappraise\b", r"\bargue\b", r"\bdefend\b", r"\bsupport\b", r"\bvalidate\b", r"\bprioritiz\w*\b", r"\brecommend\b", r"\brate\b", r"\bto\s+what\s+extent\b", r"\bdo\s+you\s+agree\b"],
    [r"\bcreate\b", r"\bdesign\b", r"\bpropose\b", r"\bformulat\w*\b", r"\binvent\b", r"\bcompose\b", r"\bplan\b", r"\bdevelop\b", r"\bgenerate\b", r"\bbuild\b", r"\bsynthesize\b", r"\bsynth[ei]s[ei]\w*\b", r"\bconstruct\s+a\b", r"\boriginal\b"],
]
ANSWER_CUES = [
    [r"\bis\s+defined\s+as\b", r"\bis\s+called\b", r"\brefers?\s+to\b", r"\bstands?\s+for\b", r"\bknown\s+as\b", r"\babbreviation\b"],
    [r"\bthis\s+means\b", r"\bin\s+other\s+words\b", r"\bfor\s+example\b", r"\bfor\s+instance\b", r"\bsuch\s+as\b", r"\bi\.e\.?\b", r"\be\.g\.?\b", r"\bin\s+simple\s+terms\b", r"\bto\s+put\s+it\b", r"\bbecause\b", r"\bsince\b", r"\btherefore\b", r"\bthus\b", r"\bhence\b"],
    [r"\bstep\s*\d?\b", r"\bfirst(?:ly)?\b.*\bthen\b", r"\bwe\s+(?:can|could)\s+use\b", r"\bapplying\s+this\b", r"\bsubstitut(?:e|ing)\b", r"\baccording\s+to\s+the\s+formula\b", r"\busing\s+(?:the\s+)?(?:method|technique|approach)\b"],
    [r"\bwhereas\b", r"\bunlike\b", r"\bin\s+contrast\b", r"\bon\s+the\s+other\s+hand\b", r"\bwhile\b", r"\bsimilar(?:ly)?\b", r"\bdiffers?\s+(?:from|in)\b", r"\bcompared?\s+(?:to|with)\b", r"\bdistinct(?:ion|ly)?\b", r"\brelationship\s+between\b", r"\bcorrelation\b", r"\bfactor\b", r"\bcomponent\b", r"\baspect\b", r"\badvantage\b", r"\bdisadvantage\b", r"\bstrength\b", r"\bweakness\b", r"\bpro(?:s)?\b.*\bcon(?:s)?\b", r"\bmore\s+(?:than|efficient|effective)\b", r"\bless\s+(?:than|efficient|effective)\b"],
    [r"\bin\s+my\s+opinion\b", r"\bi\s+(?:think|believe|argue)\b", r"\bit\s+(?:can\s+be|is)\s+argued\b", r"\boverall\b", r"\bin\s+conclusion\b", r"\bsuperi(?:or|ority)\b", r"\binferi(?:or|ority)\b", r"\bmost\s+(?:important|effective|significant)\b", r"\bshould\b", r"\bprefer(?:able|red)?\b", r"\bbest\s+(?:approach|method|solution)\b", r"\bcritical(?:ly)?\b", r"\bsignificant(?:ly)?\b", r"\beffective(?:ness)?\b", r"\bjustif(?:y|ied|ication)\b", r"\bvalid(?:ity)?\b", r"\breliab(?:le|ility)\b"],
    [r"\bi\s+(?:would\s+)?propose\b", r"\bmy\s+(?:design|approach|solution)\b", r"\ba\s+(?:new|novel|original)\s+(?:method|approach|solution|system)\b", r"\bcombining\b", r"\bintegrat(?:e|ing)\b", r"\bhypothes[ie]s\b", r"\bmodel\s+(?:that|which)\b", r"\bframework\b", r"\bblueprint\b"],
]

# Frequencies of the most common letter pairs of English.
BIGRAMS = {
    "th": 3.56, "he": 3.07, "in": 2.43, "er": 2.05, "an": 1.99, "en": 1.45, "to": 1.45, "re": 1.41, "nd": 1.35, "on": 1.32,
    "es": 1.32, "st": 1.27, "ti": 1.27, "at": 1.25, "ar": 1.11, "te": 1.09, "al": 1.09, "or": 1.06, "se": 1.00, "it": 0.97,
    "ne": 0.93, "is": 0.86, "ha": 0.84, "le": 0.84, "ed": 0.82, "ou": 0.82, "nt": 0.81, "ng": 0.80, "as": 0.79, "de": 0.76,
    "io": 0.76, "me": 0.73, "ot": 0.72, "of": 0.71, "ro": 0.69, "li": 0.68, "co": 0.67, "ve": 0.67, "ri": 0.66, "ra": 0.65,
    "el": 0.62, "so": 0.59, "ta": 0.58, "ma": 0.57, "no": 0.56, "la": 0.55, "ce": 0.54, "si": 0.53, "di": 0.52, "ic": 0.52,
    "us": 0.51, "il": 0.50, "om": 0.49, "lo": 0.49, "ur": 0.49, "pe": 0.48, "un": 0.47, "ec": 0.47, "ch": 0.46, "ea": 0.46,
    "ca": 0.45, "ge": 0.44, "wh": 0.43, "be": 0.43, "ho": 0.42, "oo": 0.41, "fo": 0.41, "ac": 0.41, "wa": 0.40, "wi": 0.39,
    "em": 0.38, "pr": 0.37, "ct": 0.37, "ss": 0.36, "nc": 0.35, "tr": 0.35, "ow": 0.34, "ad": 0.34, "po": 0.33, "ly": 0.33,
    "ns": 0.32, "ab": 0.32, "ag": 0.31, "su": 0.31, "bl": 0.30, "id": 0.30, "ie": 0.30, "ut": 0.30, "rs": 0.29, "am": 0.29,
    "mi": 0.28, "ol": 0.28, "sh": 0.28, "ai": 0.27, "mo": 0.27, "da": 0.27, "av": 0.26, "ig": 0.26, "do": 0.26, "ny": 0.25,
}

# Scoring.
GRADES = [(0.85, "excellent"), (0.70, "good"), (0.50, "average"), (0.0, "poor")]
QUESTION_WEIGHTS = {
    "factual": {"semantic": 0.20, "concept_graph": 0.25, "sentence_alignment": 0.20, "keyword": 0.25, "diagram": 0.10},
    "descriptive": {"semantic": 0.20, "concept_graph": 0.30, "sentence_alignment": 0.25, "keyword": 0.10, "diagram": 0.15},
    "diagram": {"semantic": 0.15, "concept_graph": 0.15, "sentence_alignment": 0.15, "keyword": 0.10, "diagram": 0.45},
    "mixed": {"semantic": 0.20, "concept_graph": 0.25, "sentence_alignment": 0.25, "keyword": 0.15, "diagram": 0.15},
}
RUBRICS = {
    "default": {"understanding": 0.40, "concept_coverage": 0.30, "terminology": 0.15, "structure": 0.10, "examples": 0.05},
    "factual": {"understanding": 0.20, "concept_coverage": 0.40, "terminology": 0.25, "structure": 0.10, "examples": 0.05},
    "descriptive": {"understanding": 0.40, "concept_coverage": 0.30, "terminology": 0.15, "structure": 0.10, "examples": 0.05},
    "diagram": {"understanding": 0.25, "concept_coverage": 0.30, "terminology": 0.15, "structure": 0.10, "examples": 0.20},
    "mixed": {"understanding": 0.35, "concept_coverage": 0.30, "terminology": 0.15, "structure": 0.10, "examples": 0.10},
}
CONFIDENCE_WEIGHTS = {"embedding_stability": 0.30, "keyword_consistency": 0.25, "score_agreement": 0.20, "structure_clarity": 0.15, "answer_adequacy": 0.10}
CONFIDENCE_LABELS = [(0.85, "High"), (0.70, "Medium"), (0.50, "Low"), (0.0, "Very Low")]
REVIEW_BELOW = 0.70

# Words that carry no terminology, and cues of structure, examples and application in rubrics.
FILLER = """
the a an is are was were be been being have has had do does did will would shall should may might can could
this that these those it its i we you he she they me us him her them my our your his their not no nor
and but or so if then else also very just only even still yet too
for of in on at to from by with about as into through during before after
""".split()
LIST_MARK = r"(?m)^\s*[\-•*\d]+[.)]\s"
HEADING = r"(?m)^[A-Z][^.!?]{3,40}$"
TRANSITIONS = r"\b(?:firstly|secondly|thirdly|moreover|furthermore|however|therefore|thus|hence|in\s+conclusion|finally|additionally|on\s+the\s+other\s+hand|for\s+example|in\s+summary)\b"
EXAMPLE_CUES = [
    r"\bfor\s+example\b",
    r"\bfor\s+instance\b",
    r"\bsuch\s+as\b",
    r"\be\.?g\.?\b",
    r"\bi\.?e\.?\b",
    r"\blike\s+(?:the|a|an)\b",
    r"\bincluding\b",
    r"\billustrat(?:e[sd]?|ion|ing)\b",
    r"\bnamely\b",
    r"\bspecifically\b",
]
APPLICATION_CUES = [
    r"\bin\s+(?:real\s+(?:life|world)|practice|daily\s+life|everyday)\b",
    r"\bapplicat(?:ion|ions|ed)\b",
    r"\bused?\s+(?:in|for|to)\b",
    r"\bpractical(?:ly)?\b",
]
DIAGRAM_CUES = r"\b(?:as\s+shown|diagram|figure|fig\.?|illustration|chart|table|graph)\b"
QUANTITY = r"\b\d+(?:\.\d+)?(?:\s*%|\s*°[CF]?)?\b"
INNER_NAME = r"[.!?]\s[a-z][^.]*?\b[A-Z][a-z]{2,}\b"
