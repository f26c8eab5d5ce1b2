"""Fixed values.

Word lists, code tables, patterns and formats that results depend on. They are
plain data: changing one changes the numbers in every report built on them.
"""

# Raw column layouts -----------------------------------------------------------

FILING_COLUMNS = [
    "accession", "form_type", "cik", "company", "date_filed", "registrant_type", "report_type",
    "period_of_report", "report_year", "series_count", "status",
]
SERIES_COLUMNS = ["accession", "series_id", "series_name"]
VOTE_COLUMNS = [
    "accession", "issuer_name", "cusip", "isin", "meeting_date", "vote_description", "categories",
    "vote_source", "shares_voted_total", "shares_on_loan", "how_voted", "shares_voted",
    "management_recommendation", "series_id", "other_info",
]

# Filings ----------------------------------------------------------------------

AMENDMENT_FORM = "N-PX/A"
INDEX_LINE_STARTS = ["N-PX ", "N-PX/A "]
FILER_KINDS = {"RMIC": "fund", "IM": "manager"}
REPORT_KINDS = [("notice", "notice"), ("combination", "combination"), ("voting", "voting")]
VOTING_REPORT_WORD = "VOTING"
PERIOD_FORMAT = "M/d/yyyy"

# Votes ------------------------------------------------------------------------

HEADINGS = {
    "vote_source": ["VOTE SOURCE", "PROPOSAL SOURCE"],
    "management_recommendation": [
        "MANAGEMENT RECOMMENDATION", "VOTE.VOTERECORD.MANAGEMENTRECOMMENDATION",
    ],
}
ANSWERS = {
    "FOR": ["FOR", "F", "YES", "FOR ALL"],
    "AGAINST": ["AGAINST", "A", "NO"],
    "WITHHOLD": ["WITHHOLD", "WITHHELD", "W", "WITHOLD", "WITHHOLD ALL"],
    "ABSTAIN": ["ABSTAIN"],
    "1 YEAR": ["ONE YEAR", "1 YEAR", "1", "1 YEARS", "ONE", "1YR", "1.0"],
    "2 YEARS": ["TWO YEARS", "2 YEARS", "2 YEAR", "TWO YEAR", "2", "2.0"],
    "3 YEARS": ["THREE YEARS", "3 YEARS", "3 YEAR", "THREE YEAR", "3", "3.0"],
    "NOT VOTED": [
        "TAKE NO ACTION", "TAKENOACTION", "DO NOT VOTE", "NO VOTE", "DID NOT VOTE", "NOT VOTED",
        "NONVOTING ITEM", "NONE", "N/A", "NOT APPLICABLE", "UNVOTED", "NO ACTION", "NOT VOTING",
        "DID NOTE VOTE", "NON VOTING", "NO ACTION TAKEN", "NO VOTES", "TNA", "NO SHARES VOTED",
        "NULL",
    ],
}
ANSWER_BLANK = "UNKNOWN"
ANSWER_OTHER = "OTHER"
VERSUS_MANAGEMENT = {"WITH": ["FOR", "F", "YES"], "AGAINST": ["AGAINST", "A", "NO"]}
PROPOSERS = {
    "company": ["ISSUER", "MGMT", "MANAGEMENT"],
    "shareholder": ["SECURITY HOLDER"],
}
TOPIC_FLAGS = {
    "is_environment": ["ENVIRONMENT OR CLIMATE"],
    "is_social": ["OTHER SOCIAL ISSUES", "HUMAN RIGHTS", "DIVERSITY"],
    "is_director_election": ["DIRECTOR ELECTIONS"],
    "is_say_on_pay": ["SAY-ON-PAY"],
    "is_governance": ["CORPORATE GOVERNANCE", "SHAREHOLDER RIGHTS"],
}
TOPIC_PRECEDENCE = [
    ("is_environment", "Environment"),
    ("is_social", "Social"),
    ("is_say_on_pay", "Executive pay"),
    ("is_director_election", "Director elections"),
    ("is_governance", "Governance"),
]
MEETING_WINDOW = ("2023-07-01", "2026-12-31")
DECIDED_ANSWERS = ["FOR", "AGAINST", "ABSTAIN", "WITHHOLD"]
STANDARD_ANSWERS = [
    "FOR", "AGAINST", "WITHHOLD", "ABSTAIN", "1 YEAR", "2 YEARS", "3 YEARS", "NOT VOTED",
    "UNKNOWN", "OTHER",
]
BLANK_MARKS = ["", "-", "N/A"]

# Fund and house names ---------------------------------------------------------

THEME_WORDS = (
    r"esg|sustainab\w*|climate|socially|social justice|social choice|responsib\w*|responsive|impact"
    r"|green|carbon|environmental\w*|clean energy|fossil|paris"
)
THEME_WORDS_LOOSE = (
    "esg|sustainab|climate|social|responsib|impact|green|carbon|environment|clean energy"
    "|low.carbon|fossil|paris"
)
REFERENCE_HOUSES = (
    "calvert|green century|domini|trillium|boston common|parnassus|impax|praxis|nia impact|adasina"
)
FUND_GROUPS = (
    "1 Specialist ESG houses", "2 ESG-named funds elsewhere", "3 Other funds",
)
SIBLING_OUTCOMES = (
    "same as siblings", "ESG fund more supportive", "ESG fund less supportive",
)

# Wording normalisation --------------------------------------------------------

COMPANY_SUFFIXES = (
    r"\b(the|inc|incorporated|corp|corporation|co|company|ltd|limited|plc|sa|ag|nv|se|asa|ab|as|oyj"
    r"|spa|lp|llc|holdings?|group|class [abc]|cl [abc]|com|adr|n v|s a)\b"
)
# Applied in this order to the lower-cased title.
TITLE_STEPS = [
    (r"please note that this resolution is a shareholder proposal:?", " "),
    (r"\(\d+\)\s*$", " "),
    (r"^\s*(item|proposal|proposal no\.?)?\s*\d{1,2}[a-z]?[\.\):\-]?\s*", " "),
    (r"[^a-z0-9 ]", " "),
    (r"\b(al|a i)\b", "ai"),
    (r"\b(s h|sh|shp|shareholder|shareholders|shareowner|shareowners|stockholder|stockholders"
     r"|security holder)\b", " "),
    (r"\b(if properly presented( at the( \d{4})?( annual)? meeting( of)?)?|at the annual meeting"
     r"|non binding|advisory|properly presented)\b", " "),
    (r"\b(proposal|proposals|resolution|regarding|requesting|request|requests|relating|entitled"
     r"|titled|concerning|vote|approval|approve|consider|consideration|that|the|a|an|of|on|to|for"
     r"|and|or|in|by|our|its|company|board|directors|issue|prepare|publish|produce|adopt|report"
     r"|reporting|annual|additional)\b", " "),
]
OVERLAP_WEIGHT = 0.9
MATCH_THRESHOLD = 0.5
WORDINGS_KEPT = 12

# Direction rules --------------------------------------------------------------

OPPOSES_PATTERNS = [
    r"censor", r"viewpoint", r"civil libert", r"de ?bank", r"politiciz", r"ideolog",
    r"\bcharitable\b", r"corporate giving", r"\broi\b", r"return on investment",
    r"cease (dei|cei)", r"affirmative action", r"reverse discrimination", r"faith based",
    r"religio", r"anti american", r"h 1b",
    r"china (entanglement|exposure)|operations in china|risk of china",
    r"gender based compensation", r"eeo policy risk", r"merchant category", r"takedown",
    r"impact of climate commitments", r"due to climate change policies",
    r"human rights congruency|congruency report on privacy", r"dei goals in executive pay",
    r"risks? of esg|esg and dei executive", r"delays in revising", r"dei risks",
    r"recruitment discrimination", r"advertising risks", r"financial sustainability",
    r"security resiliency",
    r"director(s)? (political and charitable|donations)|director transparency on political",
    r"financial impact of policy positions", r"voluntary carbon reduction",
    r"risks? (created by|arising from|of|related to) (the company s )?(dei|diversity equity|esg"
    r"|net zero|decarboni|climate (commitment|goal|target))",
    r"non ?fiduciary", r"fiduciary (duty|carbon|relevance)",
    r"discrimination in (genai|charitable)|risks of discrimination in gen",
    r"gender transition|detransition|puberty", r"backlash|boycott",
    r"hiring based on merit|merit based", r"abortion (travel|risk|cost)|cost of abortion",
    r"election integrity|voter", r"unmasking|transparency in vendor|content moderation",
    r"brand (misalignment|damage due to dei)|pride|lgbt.* risk",
    r"climate (alarm|skeptic)|net zero (risk|cost)|cost(s)? of (net zero|decarbon|climate)",
    r"\brevisit\b|risks? (created by|of maintaining)|objective evaluation"
    r"|financial statement assumptions",
    r"return to merit|racial discrimination audit|hiring statistics|greenwashing"
    r"|stakeholder capitalism|impact of oil and gas divestment",
    r"eliminat\w* .*(goals|targets|metrics)|remove dei|business performance risks"
    r"|stranded asset risks|brand image|improper influence|ai bias|opposing state abortion",
    r"anti ?esg|rescind|abandon|eliminate (dei|diversity|climate)|discontinue (dei|diversity)",
    r"hate speech law|free speech|freedom of (expression|speech)",
    r"partnerships? with (planned|glsen|hrc)|human rights campaign|cei participation"
    r"|corporate equality index",
]
SUPPORTS_PATTERNS = [
    r"climate|greenhouse|\bghg\b|emission|scope 3|scope three|net zero|transition plan|paris|carbon"
    r"|methane|fossil|coal\b|oil and gas|energy (supply|financing) ratio|decarbon|just transition",
    r"deforest|biodivers|nature loss|plastic|packaging|recycl|water\b|pesticide|antimicrobial"
    r"|antibiotic|regenerative|circular|pollut|toxic|chemical|waste|lead sheathed|pfas|mining"
    r"|tailings",
    r"animal welfare|treatment of animals|cage free|gestation|primate|animal testing",
    r"human rights|indigenous|conflict affected|cahra|forced labor|child labor|child safety"
    r"|children|sexual exploitation|csam|trafficking",
    r"racial equity|civil rights audit|pay (gap|equity)|gender (and|or|racial)|racial (and|gender)"
    r"|eeo 1|workforce data|harassment|non discrimination|freedom of association"
    r"|collective bargaining|union",
    r"working conditions|health and safety|workplace safety|warehouse|living wage|paid sick"
    r"|sick leave|arrest or incarceration|fair chance|healthcare|reproductive",
    r"lobbying|political (spending|contribution|expenditure|activit)|election cycle"
    r"|tax transparency|tax practices",
    r"misinformation|disinformation|hate|antisemit|deepfake"
    r"|data (privacy|usage|sourcing|collection|protection)|ai (data|oversight|board)"
    r"|artificial intelligence|weapons|surveillance|facial recognition",
    r"diversity|inclusion|\bdei\b|equity audit|stakeholder|sustainab|patent|drug pricing"
    r"|access to medicine|nutrition|sugar|tobacco|opioid|gun|firearm",
]
SUPPORTS, OPPOSES, UNCLEAR, SPLIT = "supports ESG", "opposes ESG", "unclear", "split"
TOO_FEW_VOTES = "not enough votes"
BY_REFERENCE, BY_WORDING, NOT_LABELLED = "reference votes", "wording only", "not labelled"
MIN_REFERENCE_VOTES, SUPPORTS_FROM_PCT, OPPOSES_UP_TO_PCT = 3, 60, 15

# Reports ----------------------------------------------------------------------

MIN_SCORECARD_VOTES = 20
SUPPORT_BANDS = [
    (0.10, "a) under 10%"), (0.25, "b) 10 to 25%"), (0.50, "c) 25 to 50%"),
    (0.75, "d) 50 to 75%"), (None, "e) 75% and over"),
]
MAX_PUBLISH_AGE_DAYS = 45
MAX_UNRECOGNISED_PCT = 1

# Label scoring ----------------------------------------------------------------

MODEL_LABELS = ["supports", "opposes", "unclear"]
SCORED_LABELS = ["supports", "opposes"]
NO_ANSWER = "no answer"
RULES_SYSTEM = "Keyword rules"
