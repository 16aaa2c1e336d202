"""Fixed values as the SQL twins hold them: written out again, with word boundaries of ASCII, so that a slip on the Spark side shows."""

from __future__ import annotations

SCHEDULE = r"^((?:SCHEDULE|Schedule|APPENDIX|Appendix|EXHIBIT|Exhibit)[ \t]+\d+)(?:[ \t]*[:–-][ \t]*(.+))?$"
ARTICLE = r"^((?:ARTICLE|Article)[ \t]+(?:[IVX]+|\d+))(?:[ \t]*[-–—][ \t]*(.+))?$"
SECTION = r"^(?i:section)[ \t]+(\d+\.\d+(?:\.\d+)?)(?:[ \t]*[-–—]?[ \t]*(.{0,200}))?$"
DOTTED = r"^(\d{1,2}(?:\.\d{1,3}){1,4}(?:\([a-zA-Z]{1,2}\))?)\.?(?:[ \t]+(.{0,250}))?"
BARE = r"^(\d{1,2})\.?[ \t]+([A-Z][A-Za-z][A-Za-z \t&'/-]{2,58})$"
SCHEDULE_LIKE = r"^(?i:schedule|appendix|exhibit)"
REFERENCE = r"(?i)(?:^|[^\p{L}\p{N}_])((?:clause|section|paragraph)\s+\d+(?:\.\d+)*(?:\([a-z]{1,2}\))*|(?:schedule|appendix|exhibit)\s+\d+)"
DOCUMENT_HINT = r"(?i)of\s+(?:the\s+)?([\p{L}\p{N}_\s]+?(?:Agreement|Addendum|Schedule|SOW))(?:[^\p{L}\p{N}_]|$)"
LAST_BARE_CLAUSE = 50
HINT_STOP_WORDS = ["agreement", "the", "of", "and", "for", "an", "a", "to", "initial", "this"]

QUALIFIER = (
    r"(?i)\b(?:no(?:t)?\s+warrant[sy]|makes?\s+no\s+warrant[sy]|cannot\s+guarantee|does?\s+not\s+guarantee|no\s+guarantee|best\s+endeavou?rs|reasonable\s+endeavou?rs|reasonable\s+steps|notwithstanding|subject\s+to\s+clause"
    r"|limitation\s+of\s+liability|limit(?:s|ed)?\s+(?:its\s+)?liability|shall\s+not\s+(?:be\s+)?liable|exclud(?:e|es|ing)\s+(?:any\s+)?liability|exclusive\s+remedy|sole\s+remedy|makes?\s+no\s+warranty"
    r"|provided\s+(?:always\s+)?that|except\s+(?:as|where|to\s+the\s+extent))\b"
)
OPENING = (
    r"(?i)\b(this\s+agreement|entered\s+into|made\s+(?:as\s+of|on)|hereby\s+agree|witnesseth|whereas|by\s+and\s+between|share\s+purchase|purchase\s+agreement|employment\s+agreement|non[\-\s]disclosure)\b"
)
TOC_LINE = r"\.{4,}\s*\d+\s*$"
DISPUTE_TITLE = r"(?i)(?:dispute|escalat|arbitrat|mediat|litigation|expert\s+determination)"
SERVICE_ASKED = (
    r"(?i)\b(sla|service[\s\-]?level|uptime|availability|service[\s\-]?credit|credit[s]?\s+(?:for|due)|remedies?\s+for\s+(?:downtime|outage)|performance\s+(?:credit|penalty|standard))\b"
)
FINANCIAL = r"(?i)\b(fee|charge|rate|cost|price|amount|salary|pay|remunerat|licen[sc]e|hosting|interest|uptime|availab|sla|service\s+level|percentage|credit)\b"
PARTY_ASKED = (
    r"(?i)\b(party|parties|buyer|seller|purchaser|vendor|grantor|grantee|effective\s+date|date\s+of\s+(?:this\s+)?agreement|entered\s+into|made\s+(?:as\s+of|on)|between\s+and|share|shares|units|recital)\b"
)
COMPARISON_ASKED = (
    r"(?i)\b(compare|comparison|versus|vs\.?|track|progression|history|increase|change|evolv|earliest|most\s+recent|over\s+time|between.*and|all.*work\s+order|each.*work\s+order|across.*document|version\s+histor)\b"
)
LOCATION_ASKED = r"(?i)\b(place\s+of\s+service|locat|address|office|physical|building|floor|premises|where|work\s+from|based)\b"
ADDRESS = r"(?i)\b(\d+/F|\d+th\s+floor|floor\s+\d+|building|road|street|avenue|drive|lane|plaza|tower|centre|center|office\s+at|located\s+at)\b"
DATE_ASKED = (
    r"(?i)\b(\d{1,2}[\s/\-\.]\w+[\s/\-\.]\d{4}|\d{4}[\-/]\d{2}[\-/]\d{2}|(?:january|february|march|april|may|june|july|august|september|october|november|december)\s+\d{1,2},?\s+\d{4})\b"
)
RETAINED = r"(?i)acts?\s+or\s+omissions?|before\s+the\s+effective\s+date|retained?\s+liabil|release\s+and\s+discharge|prior\s+to\s+the\s+effective\s+date|occurring\s+before|neglect|default.*before"
SCHEDULE_NAMED = r"(?i)\b((?:schedule|appendix|exhibit|annex)\s+(?:\d+|[A-Z]))\b"
ADDENDUM = (
    r"(?i)\b(is\s+an\s+addendum\s+to|as\s+an\s+addendum|addendum\s+to\s+the|pursuant\s+to\s+the\s+(?:framework|master)"
    r"|incorporates?\s+(?:the\s+)?(?:terms\s+(?:and\s+conditions\s+)?of\s+)?the\s+(?:framework|master)|issued\s+under\s+the\s+(?:framework|master))\b"
)
MONEY = r"[£€$][ \t]*\d|(?:USD|GBP|EUR|HKD|SGD|AUD)[ \t]*\d|\d[ \t]*(?:£|€|USD|GBP|EUR)|\d(?:\.\d+)?[ \t]*%"
DATE_TOLD = (
    r"(?i)(?:dated?|effective(?:\s+as\s+of)?|entered\s+into(?:\s+as\s+of)?|made\s+(?:the\s+)?|as\s+of|issue\s+date\s*[:=]?|issued\s*[:=]?|execution\s+date\s*[:=]?|signed\s*[:=]?)\s*"
    r"(\d{1,2}(?:st|nd|rd|th)?\s+(?:January|February|March|April|May|June|July|August|September|October|November|December)\s+\d{4}|\d{4}-\d{2}-\d{2}|\d{1,2}[\/\.\-]\d{1,2}[\/\.\-]\d{4})"
)
DATE_BARE = r"(?i)\b(\d{1,2}(?:st|nd|rd|th)?\s+(?:January|February|March|April|May|June|July|August|September|October|November|December)\s+\d{4})\b"
DOCUMENT_TYPES = [
    ("termination_notice", 3, r"(?i)\b(termination|notice\s+of\s+termination)\b"), ("work_order", 2, r"(?i)\b(work\s+order|statement\s+of\s+work|sow)\b"),
    ("addendum", 1, r"(?i)\b(addendum|side\s+letter|letter\s+of\s+variation)\b"), ("novation", 1, r"(?i)\b(novation|assignment|transfer)\b"),
    ("amendment", 1, r"(?i)\b(amendment|variation|supplement|restatement)\b"), ("framework", 0, r"(?i)\b(master|framework|principal)\b"),
]
ROLES = [
    ("termination", r"(?i)\b(termination\s+(?:letter|notice)|notice\s+of\s+termination)\b"),
    ("transaction", r"(?i)\b(work\s+order|statement\s+of\s+work|purchase\s+order|task\s+order|sow)\b"),
    ("modification", r"(?i)\b(novation|amendment|side\s+letter|addendum|variation|supplement|restatement)\b"),
    ("master_agreement", r"(?i)\b(master\s+(?:consultancy|services|framework)|framework\s+agreement|principal\s+agreement)\b"),
]
CUES = [
    ("EXCEPTIONS", r"(?i)except as provided|other than|excluding|save that"),
    ("SUPERSEDES", r"(?i)notwithstanding|in lieu of|replaces|overrides|prevails"),
    ("CONDITIONS", r"(?i)subject to|provided that|unless|conditional on"),
]
CLAUSE_TYPES = (
    "definitions order_of_precedence term_and_termination limitation_of_liability confidentiality intellectual_property governing_law dispute_resolution payment_terms data_protection "
    "warranties indemnification force_majeure notices schedule_or_appendix business_continuity audit_rights subcontracting general other"
).split()
CONFLICT_TYPES = "payment_terms liability limitation_of_liability sla_uptime termination term_and_termination indemnification data_protection confidentiality warranties intellectual_property".split()

#: What the contract frames add to the tables' lines, and the least content of a section.
MIN_CONTENT = 15
SUFFIXES = {
    1: " subject to clause 2.1 of the Framework Agreement",
    2: " a fee of $1,200 is payable",
    3: " at 5% per annum",
    4: " see Schedule 2",
    5: " notwithstanding clause 3.1",
    6: " located at 12 High street",
    7: " for acts or omissions before the effective date",
    8: " as in section 4.2 of the Initial Addendum",
    9: " under clause 12.3(a) of the Work Order Agreement",
    10: ' "Charges" means the sums of schedule 3',
    11: " dated 3rd March 2021",
    12: " Service Credit means a part of the fee",
    13: " it incorporates the terms of the framework",
    14: " effective as of 2022-05-06 under paragraph 61 and clause 2.2 of the SOW",
    15: " on 7 June 2019 by a Work Order",
}
