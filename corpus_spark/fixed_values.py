"""Fixed values that results depend on: vocabularies, rule lists, patterns and limits."""

# Danger tiers, least to most dangerous. The only order of tiers anywhere.
TIERS = ("Recommended", "Advanced", "Expert", "Unsafe")
OVERLAY_CAP = "Advanced"

# Rule names in report order.
RULES = (
    "core_app",
    "sole_library_provider",
    "sole_static_role_holder",
    "deny_list",
    "system_shared_uid",
    "persistent",
    "sole_core_intent_handler",
    "privileged",
    "overlay_target",
    "default",
)
SYSTEM_SHARED_UID = "android.uid.system"

# (pattern over the lower-cased package name, reason); the first hit gives the reason.
DENY_LIST = (
    (r"cellbroadcast", "cell broadcast is the transport for statutory emergency alerts"),
    (r"emergency", "emergency calling and alerting"),
    (r"(^|\.)(cmas|etws|wea)(\.|$)", "statutory alert systems (CMAS/WEA in the US, ETWS in Japan)"),
    (r"(^|\.)amber(\.|$)", "AMBER alerts"),
    (
        r"(^|\.)(sar[a-z0-9]*|[a-z0-9]*sar)(\.|$)",
        "SAR/specific-absorption-rate control, certification law in the EU",
    ),
)

# Filter verdicts, in the order the funnel reports them.
VERDICTS = ("queued", "already_upstream", "auto_generated_rro", "emulator_only")
GENERATED_OVERLAY_MARKER = "auto_generated_rro_"
EMULATOR_MARKERS = ("emulator", "sdk_gphone", "goldfish", "ranchu")

# Intent surfaces of the sole-handler rule.
HOME_ACTION = "android.intent.action.MAIN"
HOME_CATEGORY = "android.intent.category.HOME"
DIALER_ACTION = "android.intent.action.DIAL"
SMS_ACTION = "android.provider.Telephony.SMS_DELIVER"

# Service classes read off (component, action) pairs.
SERVICE_CLASSES = {
    "is_input_method": ("service", "android.view.InputMethod"),
    "is_device_admin": ("receiver", "android.app.action.DEVICE_ADMIN_ENABLED"),
    "is_accessibility_service": ("service", "android.accessibilityservice.AccessibilityService"),
    "is_carrier_service": ("service", "android.service.carrier.CarrierService"),
}
FILTER_COMPONENTS = ("activity", "activity-alias", "service", "receiver", "provider")

# Merge policies of the observation columns.
STICKY_COLUMNS = (
    "priv_app",
    "core_app",
    "persistent",
    "has_code",
    "overlay_static",
    "is_input_method",
    "is_device_admin",
    "is_accessibility_service",
    "is_carrier_service",
)
UNION_COLUMNS = (
    "libraries",
    "static_libraries",
    "uses_libraries_required",
    "uses_libraries_optional",
    "protected_broadcasts",
    "provider_authorities",
    "queries_packages",
    "content_uri_authorities",
    "intent_filters",
)
FIRST_COLUMNS = ("cert_issuer", "cert_subject", "shared_user_id", "overlay_target")
CONFLICT_COLUMNS = (
    "cert_issuer",
    "cert_subject",
    "shared_user_id",
    "core_app",
    "persistent",
    "overlay_target",
)
UNKNOWN = "unknown"

# Category vocabulary and its deterministic rules.
CATEGORIES = ("Aosp", "Carrier", "Google", "Misc", "Oem")
CONFIDENCES = ("low", "medium", "high")
OEM_NAME_TOKENS = (
    "samsung", "sec", "huawei", "hihonor", "honor", "motorola", "moto", "lge", "oneplus", "miui",
    "xiaomi", "redmi", "poco", "vivo", "oplus", "oppo", "coloros", "realme", "asus", "nubia", "zte",
    "transsion", "tecno", "infinix", "itel", "sonymobile", "sonyericsson", "tct", "alcatel", "zui",
    "lenovo", "meizu", "nothing", "evenwell", "blackview", "wingtech", "longcheer", "tinno", "hmd",
    "nokia",
)
OEM_ISSUER_ORGS = (
    "samsung", "huawei", "honor", "motorola", "lg electronics", "oneplus", "xiaomi",
    "beijing xiaomi", "vivo", "oppo", "guangdong", "realme", "asus", "zte", "transsion", "sony",
    "tcl", "lenovo", "meizu", "nothing technology", "nokia", "hmd",
)
AOSP_TEST_KEY_MARKER = "android@android.com"
AOSP_NAMESPACES = ("com.android.", "android.")

# Limits and key names of proposal and verdict responses.
FORBIDDEN_KEYS = ("dependencies", "neededBy", "needed_by", "labels")
PROPOSAL_KEYS = (
    "description",
    "list",
    "removal",
    "confidence",
    "unknown_fields",
    "reasoning_brief",
)
DESCRIPTION_MIN_CHARS = 20
DESCRIPTION_MAX_CHARS = 600
REASONING_MAX_CHARS = 400
VERDICT_KEYS = ("status", "sources", "reasoning")
ANSWERABLE_STATUSES = ("corroborated", "uncorroborated")
RETRYABLE_STATUSES = ("search_failed", "judge_failed")
RULE_PROVENANCE = "rule:corroborate"
SOURCE_PROVENANCE = "search:brave"
NO_RESULT_REASONING = "the search returned no result to judge"

# Human edits.
HUMAN_PREFIX = "human:"
HUMAN_TRIAGE = "human:triage"
SUPERSEDED_SUFFIX = "_superseded"
SUPERSEDED_BY = "rule:floor superseded"

# Evidence bundle.
BUNDLE_SCHEMA_VERSION = 1
ANCHOR_COUNT = 4
ANCHOR_MIN_SEGMENTS = 2

# Triage.
VIEWS = ("queue", "deferred", "decided", "shipped", "parked")
PAGE_SIZE = 50

# Emission.
SHARED_VENDOR = "shared"
MAX_PROSE_CHARS = 4096
MAX_NAME_CHARS = 255
MAX_NAMES_PER_FIELD = 64

# Job walks per kind.
JOB_WALKS = {
    "firmware_analysis": (
        "acquire",
        "unpack",
        "extract_facts",
        "corpus_graph",
        "filter",
        "rule_ladder",
    ),
    "classification": ("llm", "corroborate"),
    "branch_emission": ("branch",),
}

# Artifact globs over "/" + path; * crosses directories.
ARTIFACT_GLOBS = (
    "*.apk",
    "*/etc/permissions/*.xml",
    "*/etc/sysconfig/*",
    "*/etc/default-permissions/*.xml",
    "*/privapp-permissions*.xml",
    "*/default-permissions*.xml",
    "*/roles.xml",
)

# Config documents.

# Elements dropped from page text.
STRIPPED_ELEMENTS = (
    "script", "style", "nav", "footer", "noscript", "svg", "template", "iframe",
)

# Firmware reference patterns.
CATALOGUE_PATTERNS = {
    "driver": r"^[a-z0-9_]{1,32}$",
    "device": r"^[A-Za-z0-9_-]{1,64}$",
    "build": r"^[A-Za-z0-9._-]{1,64}$",
    "url": r"^https://[^\s]{1,2048}$",
    "sha256": r"^[0-9a-f]{64}$",
    "md5": r"^[0-9a-f]{32}$",
}
PARSE_FAILURE_RATIO = 0.05

# Labels of special address blocks (IANA registries); the first that holds an address counts.
# None: globally reachable parts of private blocks.
ADDRESS_NETWORKS = (
    ("6to4", ("2002::/16",)),
    ("teredo", ("2001::/32",)),
    ("loopback", ("127.0.0.0/8", "::1/128")),
    ("unspecified", ("0.0.0.0/32", "::/128")),
    ("link-local", ("169.254.0.0/16", "fe80::/10")),
    ("multicast", ("224.0.0.0/4", "ff00::/8")),
    (None, ("192.0.0.9/32", "192.0.0.10/32")),
    (None, ("2001:1::1/128", "2001:1::2/128", "2001:3::/32", "2001:4:112::/48", "2001:20::/28", "2001:30::/28")),
    ("private", ("0.0.0.0/8", "10.0.0.0/8", "172.16.0.0/12", "192.0.0.0/24", "192.0.2.0/24", "192.168.0.0/16")),
    ("private", ("198.18.0.0/15", "198.51.100.0/24", "203.0.113.0/24", "240.0.0.0/4")),
    ("private", ("64:ff9b:1::/48", "100::/64", "2001::/23", "2001:db8::/32", "fc00::/7")),
    ("reserved", ("::/8", "100::/8", "200::/7", "400::/6", "800::/5", "1000::/4", "4000::/3", "6000::/3", "8000::/3")),
    ("reserved", ("a000::/3", "c000::/3", "e000::/4", "f000::/5", "f800::/6", "fe00::/9")),
)
