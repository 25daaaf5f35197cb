"""Fixed values of the domain."""

# Topics, with the names shown to readers.
TOPIC_NAMES = {
    "4_flats_legalization": "4-Flats and Small-Scale Housing",
    "missing_middle_housing": "Missing Middle Housing",
    "accessory_dwelling_units": "Accessory Dwelling Units (ADUs)",
    "single_stair_reform": "Single-Stair Building Reform",
    "bike_lanes": "Bike Lanes and Cycling Infrastructure",
    "street_redesign": "Street Redesign and Reconstruction",
    "street_safety_or_traffic_calming": "Street Safety and Traffic Calming",
    "transit_funding": "Public Transit Funding and Service",
    "city_budget": "City Budget and Fiscal Policy",
    "tax_policy": "Tax Policy and Revenue",
    "zoning_or_development_meeting_or_approval": "Zoning and Development Approvals",
    "city_charter": "City Charter and Governance Reform",
}
TOPICS = list(TOPIC_NAMES)

# Former topics and what they are called now.
RENAMED_TOPICS = {
    "4_flats_legalization": "4_flats_legalization",
    "missing_middle_housing": "missing_middle_housing",
    "adu_coach_house": "accessory_dwelling_units",
    "single_stair_reform": "single_stair_reform",
    "bike_infrastructure": "bike_lanes",
    "street_redesign": "street_redesign",
    "cta_metra_funding": "transit_funding",
    "budget_transparency": "city_budget",
    "fiscal_sustainability": "city_budget",
    "tax_policy": "tax_policy",
    "development_approval": "zoning_or_development_meeting_or_approval",
    "public_hearing": "zoning_or_development_meeting_or_approval",
    "city_charter": "city_charter",
}

# Links, link texts and page parts that identify a reader.
URL_PATTERNS = [
    r"list-manage\.com/unsubscribe", r"list-manage\.com/profile", r"list-manage\.com/about", r"list-manage\.com/vcard", r"list-manage\.com/track/click",
    r"constantcontact\.com/do\?.*p=un", r"constantcontact\.com/do\?.*p=oo", r"constantcontact\.com/legal/customer-contact-data-notice",
    r"mailchimpsites\.com/manage/preferences", r"mailchi\.mp/.*\?e=", r"sparkpostmail\.com/f/a/.*/unsubscribe", r"forward-to-friend\.com",
    r"rs6\.net/tn\.jsp", r"constantcontact\.com/landing1/vr/home", r"login\.mailchimp\.com/signup", r"campaign-archive\.com",
]
TEXT_PATTERNS = ["unsubscribe", "update.*profile", "manage.*preferences", "subscription.*preferences", "update.*preferences", "forward.*friend", "view.*browser", "read.*browser", "address.*book"]
SELECTORS = [".complianceLinks", "#footer-links", ".footer-links", ".unsubscribe", ".mcnViewInBrowser", "#mcnViewInBrowser"]

# Prefixes of model names and the encodings they count tokens with; the first that fits counts.
ENCODINGS = {"gpt-5": "o200k_base", "gpt-4.1": "o200k_base", "gpt-4o": "o200k_base", "gpt-4": "cl100k_base", "gpt-3.5": "cl100k_base", "claude": "cl100k_base", "gemini": "cl100k_base", "grok": "cl100k_base", "deepseek": "cl100k_base", "llama": "cl100k_base"}
DEFAULT_ENCODING = "cl100k_base"
# Tokens assumed for a response, by operation.
RESPONSE_TOKENS = {"topics": 100, "summary": 150, "relevance_score": 120, "weekly_facts": 200, "weekly_synthesis": 800}

PAGE_SIZE, MAX_RULES, MAX_TERM, MAX_CHARS, REDACTED, ZONE = 20, 5, 100, 100_000, "[REDACTED]", "America/Chicago"
