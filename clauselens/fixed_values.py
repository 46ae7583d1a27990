"""Fixed values.

Everything in this module is *data that has to be equal to the published
behaviour for results to be right*: word lists, patterns, weights, thresholds,
texts.  It is stated here once, as plain text and in natural order; no other
module repeats any of it.  Patterns are written in the usual ``\\b \\w \\s \\d``
notation and are turned into Java (or RE2) regexes by ``functions.patterns``.
"""

from __future__ import annotations

# --------------------------------------------------------------------------
# Limits and thresholds
# --------------------------------------------------------------------------

ALLOWED_EXTENSIONS = ("pdf", "docx", "doc")
MAX_FILE_BYTES = 50 * 1024 * 1024

SPARSE_CHARS_PER_SQIN = 6.0
IMAGE_DOMINANCE_RATIO = 0.35
MIN_PAGE_AREA_SQIN = 0.01

CHUNK_WORDS = 300
CHUNK_OVERLAP_WORDS = 30

MAX_AMOUNTS = 10
MAX_DATES = 5
NOT_SPECIFIED = "Not Specified"

DEFAULT_THRESHOLD = 0.65
CONFIDENCE_RULE_AND_MODEL = 0.95
CONFIDENCE_EXACT_PHRASE = 0.88
CONFIDENCE_MODEL_ONLY = 0.82
CONFIDENCE_CONTEXTUAL = 0.78
CONFIDENCE_OTHER = 0.72

SEVERITY_MULTIPLIERS = {"HIGH": 3.0, "MEDIUM": 2.0, "LOW": 1.0}
SEVERITY_MULTIPLIER_OTHER = 2.0
HIGH_SCORE = 8.0
MEDIUM_SCORE = 3.5

SNIPPET_PATTERN_POINTS = 4
SNIPPET_PHRASE_POINTS = 3
SNIPPET_WORD_POINTS = 1
SNIPPET_MAX_WORDS = 65
SNIPPET_SHORT_WORDS = 25
SNIPPET_FALLBACK_CHARS = 250

SAME_PAGE_JACCARD = 0.65
OTHER_PAGE_JACCARD = 0.75

MODEL_MATCHED_CHUNKS = 12
MODEL_UNMATCHED_CHUNKS = 3
MODEL_UNMATCHED_MIN_TOKENS = 30

SUMMARY_PROMPT_CHARS = 4000
CLASSIFY_PROMPT_CHARS = 1200
ADVICE_PROMPT_CHARS = 250
ADVICE_PROMPT_CLAUSES = 6
SAMPLE_TEXT_CHARS = 60

LINK_PREFIX_CHARS = 45
BLOCK_MAX_GAP = 22.0
BLOCK_MIN_EXTENT = 2.0

STRANDED_MESSAGE = (
    "Analysis interrupted by backend service restart. "
    "Please re-run or use Force Re-analyze."
)
EMPTY_TEXT_MESSAGE = "Extracted document text is empty. PDF/DOCX might be scanned images."

# --------------------------------------------------------------------------
# Sentence splitting: abbreviations whose dots do not end a sentence
# --------------------------------------------------------------------------

ABBREVIATIONS = (
    "Rs.", "Sec.", "Secs.", "No.", "Nos.", "Art.", "Arts.",
    "Cl.", "Cls.", "para.", "paras.", "Ltd.", "Pvt.",
    "Inc.", "Corp.", "Co.", "Dr.", "Mr.", "Mrs.", "Ms.",
    "v.", "vs.", "viz.", "i.e.", "e.g.", "etc.", "al.",
)

SENTENCE_BREAK = r"(?:[.?!]+\s+|;\s*\n+|\n{2,})"

# --------------------------------------------------------------------------
# Line cleaning: (pattern, ignore case) whose match drops a line, and
# (pattern, replacement) fixes applied in this order
# --------------------------------------------------------------------------

NOISE_LINE_PATTERNS = (
    (r"Szz0H|rreDF|Orie\s+rre", False),
    (r"(?:eSigned|Signed)\s+using\s+Aadhaar", True),
    (r"^Date:\s+[A-Za-z]{3}\s+[A-Za-z]{3}\s+\d+", False),
    (r"(?:oe\s+)?br\s+Pe\s+ae\s+cecitet", True),
    (r"^[a-z]\s+\d+(?:\s+his\s*/)?$", True),
    (r"^(?:oe|ee|e)\b$", True),
)

LINE_FIXES = (
    (r"%(\d+)", "₹$1"),
    (r'\b10"\s+day\b', "10th day"),
    (r"\bérsons\b", "persons"),
    (r"7<«\s*", ""),
    (r"^\s*ee\s+", ""),
    (r"^\s*e\s+(?=Mrs\.|Mr\.|THIS|NOW)", ""),
)

SECTION_HEADING = (
    r"^(\d+[\.\)]|\([a-zA-Z0-9]+\)|Section\s+\d+|Article\s+[IVXLCDM\d]+|[A-Z][A-Za-z\s]{2,30}:)"
)
FOOTER_WORDS = ("esign", "aadhaar", "leegality")
FOOTER_DATE = r"date:\s+[a-z]{3}\s+[a-z]{3}\s+\d+"

# --------------------------------------------------------------------------
# Entity patterns (all ignore case unless said otherwise)
# --------------------------------------------------------------------------

AMOUNT_PATTERN = (
    r"(?:₹|Rs\.?|INR|\$|USD|EUR|GBP|€|£)\s?"
    r"\d{1,3}(?:,\d{2,3})*(?:\.\d{1,2})?"
    r"(?:\s?/-)?"
    r"(?:\s?(?:lakh|lac|crore|thousand|million|billion)s?)?"
)

GOVERNING_LAW_PATTERNS = (
    r"governed by (?:and construed in accordance with )?(?:the )?laws of (?:the State of )?([A-Za-z\s]{3,40})",
    r"laws of ([A-Za-z\s]{3,40}?) shall (?:apply|govern)",
    r"subject to (?:the )?laws of ([A-Za-z\s]{3,40})",
)

JURISDICTION_PATTERNS = (
    r"courts of ([A-Za-z\s]{3,40}) shall have (?:exclusive )?jurisdiction",
    r"exclusive jurisdiction of (?:the )?courts (?:at|of|in) ([A-Za-z\s]{3,40})",
    r"subject to the jurisdiction of ([A-Za-z\s]{3,40})",
)

DATE_PATTERNS = (
    r"(?:January|February|March|April|May|June|July|August|September|October|November|December)\s+\d{1,2},?\s+\d{4}",
    r"\d{1,2}(?:st|nd|rd|th)?\s+(?:day of\s+)?(?:Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec"
    r"|January|February|March|April|May|June|July|August|September|October|November|December)[,\s]+\d{4}",
    r"\d{1,2}[-/](?:Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec)[-/]\d{4}",
    r"\b\d{1,2}[-/]\d{1,2}[-/]\d{4}\b",
)

PARTY_BLOCK = (  # dot matches newlines
    r"\bbetween\s*:?\s*(.+?)\s+\band\b\s+(.+?)"
    r"(?:\n\s*\n\s*(?:WHEREAS|NOW THIS|NOW,? THEREFORE|IN WITNESS)"
    r"|WHEREAS|NOW THIS|NOW,? THEREFORE|IN WITNESS)"
)
PARTY_BLOCK_END = r"WHEREAS|NOW THIS|NOW,? THEREFORE|IN WITNESS"  # the words that close a party block
DEFINED_TERM = (
    r"(?:hereinafter\s+(?:called|referred to as)|hereinafter)\s+(?:the\s+)?"
    r"[\"']?([A-Za-z][A-Za-z\s/]{2,40}?)[\"']?[\.\)]"
)
LEADING_NAME = r"^\s*([A-Z][A-Z\.\s]{2,60}?)(?:\s+(?:S/O|D/O|W/O|R/O)\b|\s*,)"  # case matters
PARTY_NAME_WORDS = 8
OFFER_EMPLOYER = (
    r"(?:Offer Letter\s*[—\-–]\s*|offer of employment with\s+)"
    r"([A-Z0-9\s,\.\(\)]+?)(?:\s+for|\s+located|\n|\.|$)"
)
OFFER_EMPLOYEE = r"Dear\s+([A-Z][a-z]+(?:\s+[A-Z][a-z]+)+)"  # case matters
OFFER_ROLE = r"position of\s+([A-Za-z0-9\s\-_]+?)(?:\.|,|\n|reporting)"

# --------------------------------------------------------------------------
# Rule seeds: category, level, threshold, weight, description
# --------------------------------------------------------------------------

RULE_SEEDS = (
    ("Indemnity", "High", 0.75, 2.0,
     "Clauses requiring one party to compensate the other for losses, damages, or legal fees."),
    ("Unilateral Termination", "High", 0.75, 1.8,
     "Allows one party to terminate the contract without cause or with minimal notice."),
    ("Limitation of Liability", "High", 0.75, 1.8,
     "Caps or excludes financial liability for damages, direct, or indirect losses."),
    ("Non-Compete / Non-Solicitation", "Medium", 0.70, 1.4,
     "Restricts future employment, business operations, or soliciting clients/staff."),
    ("Automatic Renewal", "Medium", 0.70, 1.2,
     "Contract automatically renews unless cancelled within a strict notice window."),
    ("Governing Law & Jurisdiction", "Medium", 0.65, 1.0,
     "Designates governing state/country laws and dispute resolution courts."),
    ("Confidentiality / NDA", "Medium", 0.65, 1.0,
     "Restricts disclosure of proprietary information and trade secrets."),
    ("Arbitration", "Low", 0.60, 0.8,
     "Mandates private arbitration instead of trial by jury."),
    ("Force Majeure", "Low", 0.60, 0.5,
     "Excuses contract performance during catastrophic extraordinary events."),
    ("Probation Period & Evaluation", "Medium", 0.70, 1.2,
     "Subject to a mandatory probationary period before employment confirmation."),
    ("Intellectual Property & IP Assignment", "Medium", 0.70, 1.3,
     "Mandates assignment of all inventions, software, trade secrets, and work product to employer."),
    ("Eviction & Notice to Vacate", "High", 0.75, 2.0,
     "Terms specifying summary eviction conditions, immediate lease forfeiture, or short notice to vacate."),
    ("Late Rent Payment & Default Penalty", "High", 0.75, 1.8,
     "Penalties, compounding interest, or default fees imposed for late rent payments or non-payment."),
    ("Security Deposit Forfeiture & Deductions", "High", 0.75, 1.7,
     "Conditions under which landlord can withhold security deposits, apply non-refundable deductions, or delay refunds."),
    ("Rent Escalation & Auto-Increase", "Medium", 0.70, 1.4,
     "Provisions allowing landlord to automatically increase rent periodically or tie rent to index/inflation."),
    ("Subleasing & Assignment Restriction", "Medium", 0.70, 1.3,
     "Restrictions prohibiting tenant from subletting, assigning lease, or transferring occupancy without consent."),
    ("Maintenance & Repair Obligations", "Medium", 0.65, 1.2,
     "Assigns responsibility for structural repairs, plumbing, HVAC, or property damage costs to tenant."),
    ("Landlord Entry & Inspection Rights", "Low", 0.60, 0.8,
     "Authorizes landlord or agents to enter premises for inspection, repairs, or showing prospective tenants/buyers."),
    ("Utilities & Maintenance Fee Liabilities", "Low", 0.60, 0.7,
     "Mandates tenant payment of utility bills, trash removal, common area maintenance (CAM), or HOA dues."),
)

# --------------------------------------------------------------------------
# Category definitions: key, phrases, primary pattern (ignore case),
# context terms, snippet keywords
# --------------------------------------------------------------------------

DEFINITIONS = (
    ("indemnity",
     ("hold harmless", "indemnify and hold", "defend and hold harmless",
      "indemnify the landlord", "indemnify the employer", "indemnify and defend",
      "indemnify and keep indemnified", "indemnify, defend, and hold"),
     r"\bindemn\w*",
     ("loss", "losses", "damage", "damages", "claim", "claims", "cost", "costs", "expense",
      "expenses", "harmless", "defend", "liability"),
     ("indemnif", "indemnity", "hold harmless", "defend")),
    ("termination",
     ("without cause", "notice to vacate", "in lieu of notice", "automatically terminated",
      "terminate this agreement", "prior written notice", "written notice of termination",
      "immediate termination", "termination without notice", "written notice", "in lieu of",
      "in lieu thereof", "compensation in lieu", "notice of termination",
      "terminated by either party", "terminate employment", "termination of employment",
      "notice period", "days written notice"),
     r"\b(terminat\w*|dismiss\w*|severance|resign\w*)\b",
     ("notice", "immediate", "without cause", "at any time", "cause", "days", "month", "policy",
      "written", "employment", "party", "compensation"),
     ("terminat", "terminate", "termination", "terminated", "without cause", "notice to vacate",
      "in lieu", "written notice", "compensation in lieu", "notice period")),
    ("liability",
     ("limitation of liability", "maximum liability", "consequential damages",
      "indirect damages", "aggregate liability", "cap on liability", "cumulative liability",
      "punitive damages"),
     r"\bliabilit(?:y|ies)\b",
     ("limitation", "maximum", "cap", "consequential", "indirect", "exceed", "aggregate",
      "damages"),
     ("limitation of liability", "maximum liability", "consequential damages",
      "aggregate liability")),
    ("eviction",
     ("notice to vacate", "summary eviction", "peaceful possession", "quit and vacate",
      "handover vacant possession", "forfeiture of lease", "handover possession",
      "vacate the premises"),
     r"\b(evict\w*|vacat\w*)\b",
     ("possession", "handover", "notice", "premises", "landlord", "tenancy", "quit",
      "forfeiture"),
     ("evict", "vacate", "handover", "possession", "premises")),
    ("late rent",
     ("late fee", "interest on default", "default interest", "late payment fee",
      "overdue rent", "penalty of rs", "default penalty", "delayed payment",
      "late rent payment", "default in payment of rent"),
     r"\b(late\s+(?:fee|rent|payment|charges?)|overdue\s+(?:rent|payment|amount)"
     r"|default\s+(?:interest|penalty|fee|charges?)|interest\s+on\s+default|delayed\s+payment"
     r"|penalty\s+(?:for|on)\s+(?:late|delayed|overdue|non-payment)|default\s+in\s+payment)\b",
     ("rent", "due", "payment", "interest", "charges", "penalty", "per day", "per month",
      "overdue"),
     ("late fee", "interest on default", "default penalty", "late rent", "penalty",
      "overdue rent")),
    ("deposit",
     ("security deposit", "non-refundable deposit", "forfeiture of deposit", "deposit refund",
      "deduction from deposit", "refund of the security deposit", "withhold the deposit"),
     r"\b(security\s+)?deposit\w*\b",
     ("forfeit", "deduct", "refund", "withhold", "advance", "non-refundable", "security"),
     ("security deposit", "deposit", "forfeit", "deduct", "withhold", "refund")),
    ("non-compete",
     ("non-compete", "non-solicitation", "restrictive covenant", "solicit any client",
      "solicit any employee", "competing business", "covenant not to compete",
      "restraint of trade"),
     r"\b(non-compete|non-solicit\w*|solicit\w*|restraint)\b",
     ("client", "customer", "employee", "business", "months", "territory", "engage",
      "competing"),
     ("non-compete", "non-solicitation", "solicit", "restrictive covenant")),
    ("auto",
     ("automatic renewal", "automatically renews", "automatically renew", "auto-renew",
      "renew automatically", "automatic extension"),
     r"\b(auto-renew\w*|automatic\s+renewal|automatically\s+renews?)\b",
     ("written", "notice", "extension", "period", "expire", "subsequent"),
     ("automatic renewal", "automatically renew", "auto-renew")),
    ("governing law",
     ("governing law", "exclusive jurisdiction", "courts of", "governed by the laws",
      "subject to the jurisdiction", "laws of india", "dispute resolution and jurisdiction"),
     r"\b(governing\s+law|jurisdiction)\b",
     ("governed", "exclusive", "dispute", "construed", "subject", "laws", "court"),
     ("governing law", "jurisdiction", "exclusive jurisdiction", "courts of")),
    ("confidentiality",
     ("non-disclosure", "trade secret", "proprietary information", "confidential information",
      "duty of confidentiality", "confidentiality agreement"),
     r"\b(confident\w*|non-disclosure|nda|trade\s+secrets?|proprietary\s+information)\b",
     ("proprietary", "recipient", "obligation", "unauthorized", "information", "disclosure",
      "secret"),
     ("confidential", "non-disclosure", "trade secrets", "proprietary information")),
    ("arbitration",
     ("binding arbitration", "arbitral tribunal", "arbitration and conciliation",
      "arbitration act", "sole arbitrator", "arbitration proceedings"),
     r"\barbitrat\w*",
     ("dispute", "binding", "award", "panel", "tribunal", "rules", "arbitrator"),
     ("arbitration", "arbitrate", "binding arbitration", "arbitral tribunal")),
    ("force majeure",
     ("force majeure", "act of god", "beyond reasonable control", "unforeseen circumstances",
      "frustration of contract"),
     r"\bforce\s+majeure\b",
     ("event", "delay", "prevent", "performance", "obligation", "circumstances"),
     ("force majeure", "act of god", "beyond reasonable control")),
    ("rent escalation",
     ("rent escalation", "rent increment", "annual increment", "increase in rent",
      "escalation of rent", "escalation clause", "rent shall increase", "shall increase by",
      "annual increase", "rent revision"),
     r"\b(rent\s+escalat\w*|rent\s+increment|increase\s+in\s+rent|rent\s+shall\s+increase"
     r"|shall\s+increase\s+by|\d+%\s+increase|annual\s+increment|escalat\w*)\b",
     ("rent", "escalat", "increment", "increase", "annual", "percentage", "rate", "year"),
     ("rent escalation", "rent increment", "increase in rent", "escalat",
      "rent shall increase")),
    ("subleas",
     ("subletting or assignment", "assignment restriction", "assign or transfer",
      "part with possession", "underlet or sublet", "assign this agreement"),
     r"\b(sublet\w*|subleas\w*|assignment\s+restriction)\b",
     ("tenant", "premises", "permission", "consent", "written", "transfer", "assign"),
     ("sublet", "sublease", "assignment restriction", "assign or transfer")),
    ("maintenance",
     ("structural repairs", "major repairs", "wear and tear", "maintenance and repairs",
      "tenant shall repair", "keep in good repair"),
     r"\b(repair\w*|maintenance|maintain\w*)\b",
     ("tenant", "second party", "cost", "damage", "wear and tear", "structural"),
     ("maintenance", "repair", "structural repairs", "wear and tear")),
    ("landlord entry",
     ("right of entry", "inspect the premises", "enter upon the premises",
      "inspection of premises", "access at reasonable times", "entry by landlord",
      "landlord shall have the right to enter", "inspection by landlord"),
     r"\b(landlord\s+entry|right\s+of\s+entry|entry\s+by\s+(?:the\s+)?landlord"
     r"|inspect(?:ion)?\s+(?:of\s+)?(?:the\s+)?premises|enter\s+(?:upon\s+)?(?:the\s+)?premises"
     r"|access\s+(?:at\s+reasonable|for\s+(?:the\s+purpose\s+of\s+)?inspection))\b",
     ("landlord", "lessor", "first party", "owner", "inspection", "reasonable notice",
      "reasonable hours"),
     ("landlord entry", "inspect the premises", "right of entry", "entry by landlord")),
    ("utilit",
     ("electricity charges", "water charges", "maintenance charges", "utility charges",
      "utility bills", "common area maintenance", "utility expenses", "gas charges",
      "power charges", "maintenance fee"),
     r"\b(utilit(?:y|ies)|electricity|water\s+charges?|maintenance\s+fees?|gas\s+charges?"
     r"|power\s+bills?|utility\s+bills?)\b",
     ("tenant", "second party", "occupant", "bill", "meter", "payment", "charges", "pay"),
     ("utility", "utilities", "electricity", "water charges", "maintenance fee",
      "utility bills")),
    ("probation",
     ("probation period", "probationary period", "confirmation of employment",
      "confirmation of service", "period of probation"),
     r"\b(probation\w*)\b",
     ("period", "months", "evaluation", "confirmation", "performance", "employment"),
     ("probation", "probationary", "probation period")),
    ("intellectual property",
     ("intellectual property", "ip assignment", "work for hire", "work product",
      "inventions and patents", "proprietary rights", "assignment of inventions"),
     r"\b(intellectual\s+property|ip\s+assignment|invention\w*|work\s+product)\b",
     ("property", "assign", "employer", "work", "rights", "ownership", "inventions"),
     ("intellectual property", "ip assignment", "inventions", "work product")),
)

# Category spelling -> definition key
CATEGORY_ALIASES = (
    ("rent escalation & auto-increase", "rent escalation"),
    ("rent escalation", "rent escalation"),
    ("utilities & maintenance fee liabilities", "utilit"),
    ("utilities & maintenance fee", "utilit"),
    ("utilities", "utilit"),
    ("utility", "utilit"),
    ("maintenance & repair obligations", "maintenance"),
    ("maintenance & repair", "maintenance"),
    ("maintenance", "maintenance"),
    ("landlord entry & inspection rights", "landlord entry"),
    ("landlord entry", "landlord entry"),
    ("security deposit forfeiture & deductions", "deposit"),
    ("deposit forfeiture", "deposit"),
    ("deposit", "deposit"),
    ("late rent payment & default penalty", "late rent"),
    ("late rent", "late rent"),
    ("eviction & notice to vacate", "eviction"),
    ("eviction", "eviction"),
    ("subleasing & assignment restriction", "subleas"),
    ("subleasing", "subleas"),
    ("sublease", "subleas"),
    ("automatic renewal", "auto"),
    ("auto-renewal", "auto"),
    ("auto renewal", "auto"),
    ("indemnity & hold harmless", "indemnity"),
    ("indemnity", "indemnity"),
    ("unilateral termination", "termination"),
    ("termination", "termination"),
    ("limitation of liability", "liability"),
    ("liability", "liability"),
    ("non-compete & non-solicitation", "non-compete"),
    ("non-compete", "non-compete"),
    ("governing law & jurisdiction", "governing law"),
    ("governing law", "governing law"),
    ("confidentiality & non-disclosure", "confidentiality"),
    ("confidentiality", "confidentiality"),
    ("arbitration & dispute resolution", "arbitration"),
    ("arbitration", "arbitration"),
    ("force majeure", "force majeure"),
    ("probation & confirmation terms", "probation"),
    ("probation", "probation"),
    ("ip assignment & work for hire", "intellectual property"),
    ("intellectual property", "intellectual property"),
)

# In the substring step, this key is skipped for categories holding this text
SUBSTRING_GUARD = ("auto", "auto-increase")

# --------------------------------------------------------------------------
# Curated advice, tried in this order; and the text used when none applies
# --------------------------------------------------------------------------

CURATED_ADVICE = (
    ("indemnity", "Request mutual indemnification and negotiate an aggregate liability cap limited to fees paid under this agreement."),
    ("termination", "Negotiate a mandatory written notice period of at least 30 days prior to any termination without cause."),
    ("liability", "Ensure liability is mutually capped and consequential, punitive, or indirect damages are explicitly disclaimed."),
    ("eviction", "Ensure formal notice and a minimum 30-day cure period are required prior to any eviction or possession handover."),
    ("late rent", "Verify that a reasonable grace period (e.g., 5-10 business days) is provided before default interest or late fees apply."),
    ("deposit", "Define explicit timelines (e.g., 14-30 days) and require an itemized written statement for any security deposit deductions."),
    ("non-compete", "Negotiate to narrow the non-compete duration (maximum 6 months) and restrict its geographic and industry scope."),
    ("auto", "Require the counterparty to provide written advance reminder notice (at least 30 days) prior to any automatic renewal."),
    ("governing law", "Confirm that the designated governing law and dispute jurisdiction are convenient and appropriate for both parties."),
    ("confidentiality", "Ensure non-disclosure obligations are bilateral and carve out standard exclusions (public domain, prior possession)."),
    ("arbitration", "Ensure arbitration rules are balanced, with costs shared equally and proceedings held in a neutral forum."),
    ("force majeure", "Ensure force majeure provisions protect both parties equally against unforeseeable disruptions."),
    ("rent escalation", "Cap future rent escalations to a predefined percentage or tie increments to official inflation indexes."),
    ("subleas", "Request that assignment or subleasing permissions cannot be unreasonably withheld, conditioned, or delayed."),
    ("maintenance", "Clarify that the landlord is responsible for major structural repairs and the tenant only for minor upkeep."),
    ("landlord entry", "Require at least 24 to 48 hours prior written notice before landlord entry, except in genuine emergencies."),
    ("utilit", "Ensure utility metering is individual and based on verified actual consumption rates rather than arbitrary flat charges."),
    ("probation", "Clarify objective, measurable performance criteria and notice standards required to complete the probationary period."),
    ("intellectual property", "Ensure IP assignment applies strictly to work product created during working hours using employer equipment."),
)
GENERIC_ADVICE = "Review this %s clause carefully with your legal counsel before signing."
NO_DESCRIPTION = "No description provided."
GENERIC_EXPLANATION = "Flagged risky clause under category %s."
GENERIC_SUMMARY = "Summary of %s: Legal agreement containing %d clause sections."

# --------------------------------------------------------------------------
# Clause localisation: substring of "type explanation" -> words to look for
# --------------------------------------------------------------------------

LOCATION_TERMS = (
    ("terminat", ("terminat", "notice", "dismiss", "severance", "resignation", "without cause", "unilateral", "in lieu")),
    ("confidential", ("confident", "non-disclosure", "nda", "proprietary", "secret")),
    ("intellectual", ("intellectual", "ip", "assignment", "inventions", "work product")),
    ("probat", ("probat", "evaluation", "trial")),
    ("deposit", ("deposit", "forfeit", "deduct", "security")),
    ("non-compete", ("compete", "solicit", "restraint", "exclusivity")),
    ("arbitrat", ("arbitrat", "dispute", "jurisdiction", "governing law")),
    ("indemn", ("indemn", "hold harmless", "liability", "defend")),
    ("liabilit", ("liability", "limitation", "damages", "consequential", "maximum liability", "cap")),
    ("rent", ("rent", "escalat", "increment", "lease term", "monthly rent", "penalty for unauthorized")),
    ("maintenance", ("repair", "maintenance", "tenant", "landlord", "minor repairs", "neat and clean")),
    ("subleas", ("sublet", "subleas", "assignment restriction", "under any circumstances", "part of the said property")),
    ("governing", ("governed by", "governing law", "jurisdiction")),
    ("evict", ("evict", "vacate", "possession", "forfeiture", "handover", "completion of the tenancy", "house for rent")),
    ("inspect", ("inspect", "entry", "reasonable hours", "authorized person", "access", "reserves the right")),
    ("late rent", ("late fee", "default", "interest", "penalty", "arrears", "unauthorized")),
    ("penalty", ("penalty", "unauthorized", "occupants", "fine", "additional penalty", "prior written approval")),
    ("utilit", ("electricity", "water", "utility", "charges", "bills", "maintenance fee", "meter")),
)
LOCATION_MIN_WORD = 4
LOCATION_PREFIX_WORDS = 4
