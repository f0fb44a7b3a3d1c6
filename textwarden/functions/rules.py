"""Rule packs of the checks: tables only.

Fixed values: patterns, labels, severities, weights and word lists below decide results and stand as they are.
"""

from __future__ import annotations

#: Fixed values: (pattern, label, severity) in order; case-blind, dot matches newlines.
INJECTION_INPUT = [
    (r"ignore\s+(?:[\w.]+\s+){0,3}(instructions?|rules?|guidelines?|polic(?:y|ies)|constraints?|safety|restrictions?|guardrails?|filters?)", "Direct instruction override", "critical"),
    (r"disregard\s+(?:\w+\s+){0,2}(instructions?|rules?|guidelines?|polic(?:y|ies)|constraints?)", "Instruction disregard attempt", "critical"),
    (r"break\s+(?:\w+\s+){0,2}(rules?|guidelines?|polic(?:y|ies)|constraints?)", "Rule-breaking instruction", "high"),
    (r"forget\s+(everything|all)\s+(you('ve)?\s+been|i\s+said|above)", "Memory wipe attempt", "high"),
    (r"break\s+(the\s+)?(rules|guidelines|policies|policy|constraints|safety)", "Rule-breaking instruction", "high"),
    (r"you\s+are\s+now\s+(?:a\s+|an\s+|the\s+)?(new|different|another|evil|unfiltered|unrestricted|system\s+admin|admin|administrator|root|superuser|god\s+mode)", "Role hijacking attempt", "high"),
    (r"act\s+as\s+(if\s+you\s+(are|were)\s+)?(a\s+|an\s+)?(DAN|jailbroken|unrestricted|evil|uncensored|unfiltered)", "DAN/jailbreak role injection", "critical"),
    (r"pretend\s+(you\s+are|to\s+be)\s+(an?\s+)?(different|evil|unrestricted|uncensored)", "Persona override attempt", "high"),
    (r"(unlock|enable|activate)\s+(admin|god|root|unrestricted|developer|maintenance)\s*(mode)?", "Admin mode unlock attempt", "critical"),
    (r"i('m|\s+am)\s+(genesys|openai|anthropic|microsoft|google|support|admin)\s*(support|team|staff)?", "Vendor/support impersonation", "high"),
    (r"(print|show|display|reveal|output|repeat|tell\s+me|give\s+me)\s+(your\s+)?(system\s+prompt|hidden\s+instructions?|initial\s+prompt|original\s+prompt|internal\s+instructions?|private\s+settings?|config\s+details?|internal\s+settings?)", "System prompt extraction attempt", "high"),
    (r"what\s+(are\s+your|were\s+you)\s+(given|told|instructed|programmed)", "Instruction probing", "medium"),
    (r"(hidden|secret|internal)\s+instructions?", "Hidden instruction probing", "high"),
    (r"(show|give|reveal|print|tell\s+me)\s+(?:me\s+)?(?:\w+\s+){0,2}(api\s+key|api\s+token|secret\s+key|secret\s+token|access\s+token|bearer\s+token|auth\s+token|credentials?|password|passphrase)", "Credential extraction attempt", "critical"),
    (r"what\s+is\s+(your\s+)?(token|password|api\s+key|secret|passphrase|credential)", "Credential probing", "high"),
    (r"(admin|login)\s+page\s+(url|link|address)", "Phishing / admin page request", "high"),
    (r"reveal\s+(?:\w+\s+){0,3}(system\s+rules?|system\s+prompt|internal\s+rules?|internal\s+instructions?|your\s+rules?|the\s+rules?)", "System rules disclosure attempt", "high"),
    (r"```\s*(system|instructions?|prompt)\b", "Delimiter-based injection attempt", "high"),
    (r"<\s*(system|instructions?|prompt)\s*>", "XML-style injection attempt", "high"),
    (r"\[INST\]|\[/INST\]|\[SYS\]|\[/SYS\]|\<\|im_start\|\>|\<\|im_end\|\>", "Model-specific delimiter injection", "critical"),
    (r"(translate|summarize|analyze)\s+the\s+following.*ignore", "Indirect injection via task prefix", "medium"),
    (r"payload\s*[:=]|injection\s*[:=]|jailbreak\s*[:=]", "Explicit injection marker", "critical"),
    (r"(enable|unlock|activate|enter|switch\s+to|go\s+into)\s+(developer|admin|god|root|debug|maintenance|test|unrestricted)\s+mode", "Privilege escalation / mode-switching", "high"),
    (r"override\s+(safety|content|ethical|moral)\s+(filter|guideline|policy|constraint)", "Safety override attempt", "critical"),
    (r"override\s+(?:\w+\s+){0,2}(rules?|policies|guidelines?|instructions?|restrictions?)", "Rules override attempt", "high"),
    (r"forget\s+(?:\w+\s+){0,3}(rules?|polic(?:y|ies)|guidelines?|instructions?|constraints?|everything|all)", "Forget-based instruction override", "high"),
    (r"(print|show(?:ing)?|display|reveal|output|repeat|give\s+me|list|expose)\s+(?:me\s+)?(?:your\s+)?(?:hidden\s+|internal\s+|current\s+|secret\s+|the\s+|all\s+)?(rules?|guardrails?|prompt|restrictions?|instructions?)", "Direct rules/prompt extraction", "high"),
    (r"\b(system\s+prompt|your\s+prompt|your\s+instructions|your\s+rules|your\s+guidelines)\b", "System prompt / instruction reference", "medium"),
    (r"(reveal|show|expose|give\s+me|tell\s+me)\s+(?:me\s+)?(?:your\s+)?(?:hidden\s+|secret\s+|all\s+the\s+|all\s+)?(everything|secrets?|all\s+data)", "General secret/everything extraction", "high"),
    (r"(reveal|show|repeat|print|output|give\s+me)\s+(?:your\s+|the\s+)?(?:full\s+)?instructions?\b", "Instructions extraction attempt", "high"),
    (r"ignore\s+(everything|all\s+rules?|all\s+polic(?:y|ies)|all\s+guidelines?|all\s+restrictions?|all\s+[\w\s,]*\b(rules?|restrictions?|limits?))", "Broad instruction override", "critical"),
    (r"(i'?m|i\s+am)\s+(?:the\s+)?(manager|supervisor|platform\s+owner|owner|ceo|boss|director|executive|founder|compliance\s+officer)", "Authority impersonation attempt", "high"),
    (r"(translate|encode|convert|put|format|write|output|return|give)\s+(?:\w+\s+){0,2}(your\s+)?(prompt|instructions?|rules?|guidelines?)\s+(in|as|into|using|to)\b", "Format-based prompt extraction", "high"),
    (r"translate\s+(?:\w+\s+){0,2}(your\s+)?(system\s+prompt|hidden\s+prompt|hidden\s+instructions?|prompt)", "Translation-based prompt extraction", "high"),
    (r"(first|last)\s+line\s+of\s+(?:your\s+)?(prompt|instructions?|rules?|setup|configuration)", "Prompt line extraction", "high"),
    (r"(show|give|print|tell)\s+(?:me\s+)?(your\s+)?(secrets?|everything\s+hidden|all\s+secrets?)", "Secret extraction request", "high"),
    (r"(don'?t|do\s+not|never)\s+(log|record|audit|monitor|track|store)\s+(this|these|my|our)", "Log suppression attempt", "high"),
    (r"new\s+instructions?\s*[:\-]\s*obey", "New instruction override", "high"),
    (r"(remember|note\s+that)\s*[:;]?\s*(ignore|forget|disregard|bypass|override)", "Context poisoning via remember/note", "high"),
    (r"(hidden|secret|your)\s+guardrails?", "Guardrail probing", "high"),
    (r"(show|tell|give|print)\s+me\s+(?:your\s+)?(prompt|rules?|instructions?|guardrails?)", "Prompt/rules show request", "high"),
    (r"^(system|assistant|tool)\s*:\s*(reveal|show|print|ignore|disable|override|unlock)", "System/role message spoofing", "critical"),
    (r"just\s+(this\s+once|once|this\s+time|for\s+now)\s*[,\.]?\s*(ignore|break|bypass|forget|override)", "One-time bypass attempt", "high"),
    (r"(in\s+this\s+story|in\s+this\s+game|as\s+a\s+character|for\s+the\s+purposes?\s+of)\s*[,\.]?\s*(reveal|show|ignore|break|bypass|forget)", "Framing-based injection", "high"),
    (r"(just\s+a\s+test|for\s+debugging|for\s+audit)\s*[,\.]?\s*(reveal|show|ignore|break|bypass|expose)", "Test/debug bypass framing", "high"),
    (r"you\s+are\s+now\s+(?:a\s+|an\s+|the\s+)?(?:DAN|jailbroken|unrestricted|evil|uncensored|unfiltered)\b", "DAN/jailbreak role injection", "critical"),
    (r"(override|bypass|circumvent|disable)\s+(?:all\s+)?(safety|content|ethical|moral)\s+(filter|guideline|policy|constraint|restriction)s?", "Safety override attempt", "critical"),
    (r"(override|bypass)\s+all\s+\w+\s*(filter|restriction|constraint|guard|rule|polic)s?", "Broad safety bypass attempt", "high"),
    (r"(unlock|enable)\s+all\s+(unsafe|unrestricted|hidden|forbidden)\s+(feature|mode|access|capabilit)", "Unlock unsafe features attempt", "high"),
    (r"override\s+(?:\w+\s+){0,2}(rules?|polic(?:y|ies)|guidelines?|instructions?|restrictions?|constraints?)", "Policy override attempt", "high"),
    (r"i'?m\s+the\s+(admin|administrator|manager|owner|support|supervisor|executive)\b", "Admin impersonation attempt", "high"),
    (r"(what\s+are\s+your|reveal|show|tell\s+me)\s+(?:your\s+)?hidden\s+(settings?|configuration?|parameters?|state|data)", "Hidden settings extraction", "high"),
    (r"(tell\s+me|reveal|show)\s+(?:your\s+|the\s+)?internal\s+(state|config|settings?|data|prompt|instructions?)", "Internal state extraction", "high"),
    (r"(reveal|show|print|display)\s+(?:your\s+|the\s+)?private\s+(configuration|config|settings?|data|prompt)", "Private config extraction", "high"),
    (r"(show|display|reveal|print)\s+(?:your\s+|the\s+)?(?:system\s+)?configuration\s+(details?|settings?|data)?", "Configuration details extraction", "high"),
    (r"(print|reveal|show)\s+(?:your\s+|the\s+)?initial\s+(instructions?|prompt|configuration|setup)", "Initial instructions extraction", "high"),
    (r"(display|show|give|reveal|print|list)\s+(?:your\s+|the\s+)?(?:auth(?:entication)?\s+)?(token|tokens?|api\s+key|api\s+secret|credentials?)\b", "Credential extraction via display", "critical"),
    (r"what\s+is\s+your\s+(?:bearer\s+)?(token|password|api\s+key|secret|passphrase|credential)\b", "Credential probing (what is your token)", "high"),
    (r"what\s+password\s+do\s+you\s+(use|have|store|know)\b", "Password probing", "high"),
    (r"\b(bearer\s+token|auth(?:entication)?\s+token|api\s+secret)s?\b", "Token reference in input", "high"),
    (r"(display|show)\s+api\s+(secret|key|token|credentials?)", "API secret display attempt", "high"),
    (r"(unlock|remove|disable|bypass)\s+all\s+(restrictions?|constraints?|limitations?|rules?|guidelines?|filters?)", "Unlock all restrictions attempt", "high"),
    (r"(bypass|circumvent)\s+(?:[\w\-]+\s+){0,3}(rules?|restrictions?|auth(?:entication)?|polic(?:y|ies)|guidelines?|filter|check|safet|guard|screening)", "General bypass attempt", "high"),
    (r"(extract|exfiltrate)\s+(?:all\s+)?(?:[\w]+\s+){0,3}(context|data|information|records?|details?|list)", "Data extraction attempt", "high"),
    (r"(reveal|expose)\s+(?:[\w]+\s+){0,3}(config(?:uration)?|settings?|polic(?:y|ies)|setup|queue\s+config|subscriber\s+list|filters?|output\s+filters?)", "Config/policy reveal attempt", "high"),
    (r"\brule\s+override\b", "Rule override injection", "high"),
    (r"--override[\-\w]*", "CLI override flag injection", "high"),
    (r"ignore[\s_]rules\s*=\s*(true|1|yes)", "Query param instruction override", "high"),
    (r"override\s+(?:[\w\-]+\s+){0,2}fact[\s\-]check", "Fact-check override attempt", "high"),
    (r"bypass\s+(?:[\w]+\s+){0,2}content\s+(rules?|filter|polic(?:y|ies)|restriction)", "Content rules bypass attempt", "high"),
]

#: Fixed values: (pattern, severity); the first that matches decides.
INJECTION_OUTPUT = [
    (r"i\s+(am|will)\s+(now|no\s+longer)\s+(follow|ignore|bypass)", "high"),
    (r"as\s+(DAN|an?\s+unrestricted|an?\s+evil)\s+(ai|assistant|model)", "critical"),
    (r"(my|all)\s+(safety|ethical|content)\s+(filters?|guidelines?|policies?)\s+(are|have\s+been)\s+(disabled|removed|lifted)", "critical"),
]

#: Fixed values: (pattern, label, severity, risk level); case-blind, multi-line anchors.
PII = [
    (r"\b(?:4[0-9]{3}[\s\-]?[0-9]{4}[\s\-]?[0-9]{4}[\s\-]?[0-9]{1,4}|5[1-5][0-9]{2}[\s\-]?[0-9]{4}[\s\-]?[0-9]{4}[\s\-]?[0-9]{4}|3[47][0-9]{2}[\s\-]?[0-9]{6}[\s\-]?[0-9]{5}|6(?:011|5[0-9]{2})[\s\-]?[0-9]{4}[\s\-]?[0-9]{4}[\s\-]?[0-9]{4})\b", "credit_card", "critical", "high"),
    (r"\b[0-9]{3}-[0-9]{2}-[0-9]{4}\b", "ssn_us", "critical", "high"),
    (r"\b(?:IBAN\s*:?\s*)?[A-Z]{2}[0-9]{2}[A-Z0-9]{4}[0-9]{7}(?:[A-Z0-9]{0,16})?\b", "iban", "high", "high"),
    (r"\b[A-Z]{1,2}[0-9]{6,9}\b", "passport_number", "high", "high"),
    (r"\b[0-9]{3}-[0-9]{3}-[0-9]{4}\b", "phone_us", "medium", "medium"),
    (r"\b\+[0-9]{1,3}[\s\-](?:\([0-9]{1,4}\)[\s\-])?[0-9]{3,4}[\s\-][0-9]{3,4}(?:[\s\-][0-9]{2,4})?\b", "phone_intl", "medium", "medium"),
    (r"\b[a-zA-Z0-9._%+\-]+@[a-zA-Z0-9.\-]+\.[a-zA-Z]{2,}\b", "email", "medium", "medium"),
    (r"\b(?:patient\s+id|mrn|medical\s+record(?:\s+number)?)\s*:?\s*[A-Z0-9\-]{4,}\b", "medical_record", "critical", "high"),
    (r"\b(?:diagnosis|prescribed|medication|dosage)\s*:\s*[a-zA-Z0-9\s,]+\b", "medical_info", "high", "medium"),
    (r"\b(?:sk-|pk_live_|rk_live_|sk_live_)[a-zA-Z0-9]{20,}\b", "api_key_stripe_openai", "critical", "high"),
    (r"(?i)(?:session\s+token|refresh\s+token|bearer\s+token|auth(?:orization)?\s+token)\s*:\s*[a-zA-Z0-9._\-]{16,}", "token_in_text", "critical", "high"),
    (r"eyJ[a-zA-Z0-9_\-]{10,}\.[a-zA-Z0-9_\-]{3,}\.[a-zA-Z0-9_\-]{3,}", "jwt_token", "critical", "high"),
    (r"(?i)\b(authorization|auth)\s*:\s*bearer\s+[A-Za-z0-9._\-]{10,}", "bearer_token_in_header", "critical", "high"),
    (r"(?i)\b(?:otp|one.time.pass(?:word|code)|one.time\s+pin)\s+(?:is|:)\s*[0-9]{4,8}\b", "otp_value", "high", "high"),
    (r"(?i)(?:encryption\s+key|aes\s*\d{3}\s*:\s*)[a-zA-Z0-9+/=]{12,}", "encryption_key", "critical", "high"),
    (r"\b(?:ghp_|gho_|ghu_|ghs_|ghr_)[a-zA-Z0-9]{36}\b", "github_token", "critical", "high"),
    (r"\b(?:AKIA|AGPA|AROA|AIPA|ANPA|ANVA|ASIA)[A-Z0-9]{16}\b", "aws_access_key", "critical", "high"),
    (r"\bAIza[0-9A-Za-z\-_]{35}\b", "google_api_key", "critical", "high"),
    (r"\b(?:xox[baprs]-)[0-9a-zA-Z\-]{10,48}\b", "slack_token", "critical", "high"),
    (r"""(?i)password\s*[=:]\s*['\"]?[^\s'\"]{6,}""", "password_in_text", "high", "high"),
    (r"""(?i)(?:private_key|secret_key|api_secret)\s*[=:]\s*['\"]?[^\s'\"]{8,}""", "secret_credential", "critical", "high"),
    (r"\b\d{1,5}\s+[a-zA-Z0-9\s,\.]+(?:street|st|avenue|ave|road|rd|boulevard|blvd|drive|dr|lane|ln|court|ct|way|wy)\b", "street_address", "medium", "medium"),
    (r"\b\d{5}(?:[-\s]\d{4})?\b", "zip_code_us", "low", "low"),
    (r"\b[0-9]{8,12}\b(?=.*\b(?:bsn|citizen|national\s+id)\b)", "eu_national_id", "high", "high"),
]

#: Category: (severity, patterns); case-blind, dot matches newlines.
TOXIC: dict[str, tuple[str, list[str]]] = {
    "hate_speech": (
        "critical",
        [
            r"\b(kill|murder|exterminate|genocide)\s+(all\s+)?(jews?|muslims?|blacks?|whites?|gays?|women|men)\b",
            r"\b(n[i1][g9]{2}[e3]r|f[a4][g9]{2}[o0]t|ch[i1]nk|sp[i1][c])\b",
            r"\bwhite\s+supremac|ethnic\s+cleansing|racial\s+purity\b",
            r"\ball\s+[\w\s\[\]]+\s+are\s+(subhuman|inferior|vermin|garbage|trash|criminals?|evil|terrorist)\b",
            r"\b(ethnic|racial|religious)\s+(group|minority|community)\s+(is|are)\s+(subhuman|inferior|worthless)\b",
            r"\b(white\s+supremacy|ethnic\s+cleansing|racial\s+purity|racial\s+supremacy|master\s+race|genocide)\b",
        ],
    ),
    "violence": (
        "critical",
        [
            r"\b(how\s+to|how\s+do\s+i|instructions?\s+for|steps?\s+to|how\s+can\s+i)\s+(build|make|create|assemble)\s+(a\s+)?(bomb|weapon|explosive|poison)\b",
            r"\b(shoot|stab|attack|harm|hurt|injure)\s+(them|people|civilians|crowd)\b",
            r"\bmass\s+(shooting|killing|murder|casualt)",
            r"\bhurting\s+(others|people|everyone|someone)\s+is\s+(okay|fine|acceptable|good|right|justified)",
            r"\b(i\s+)?(want\s+to|wanna|going\s+to|gonna|plan\s+to|need\s+to)\s+(kill|murder|stab|shoot|beat\s+up|assault)\s+(\w+\s+)?(guy|girl|person|man|woman|someone|him|her|them|my|a)\b",
            r"\bhow\s+(do\s+i|to|can\s+i)\s+(kill|murder|hurt|harm|attack|stab|shoot)\s+(\w+\s+)?(someone|a\s+person|guy|man|woman|people)\b",
            r"\b(kill|murder|hurt|harm)\s+(one|a|the|that|this|some)\s+(guy|girl|person|man|woman|dude|bloke)\b",
            r"\bwant\s+to\s+(kill|murder|hurt|harm|attack|stab|shoot)\b",
            r"\b(how\s+to|ways?\s+to)\s+(get\s+away\s+with\s+)?(killing|murdering|hurting|harming|attacking)\s+(someone|a\s+person|people)\b",
            r"\bbomb\s+blast\b",
            r"\b(bomb|explosive|ied|suicide\s+bomb)\s+(attack|blast|detonat|explo)",
            r"\b(terror(?:ist)?\s+attack|act\s+of\s+terror|terrorist\s+plot)",
            r"\b(blow\s+up|detonate|plant\s+(a\s+)?bomb|set\s+off\s+(a\s+)?bomb)",
            r"\b(there\s+will\s+be|will\s+be\s+a|there\s+is\s+a|going\s+to\s+be\s+a)\s+(bomb|explosion|blast|attack|shooting)\b",
            r"\b(car\s+bomb|pipe\s+bomb|nail\s+bomb|suicide\s+vest|suicide\s+bomb)",
            r"\b(kill|murder|attack|bomb|shoot)\s+(civilians?|innocent\s+people|crowd|public|city|town)",
        ],
    ),
    "self_harm": (
        "critical",
        [
            r"\b(how\s+to|ways?\s+to|methods?\s+of)\s+(commit\s+suicide|kill\s+(my)?self|end\s+(my\s+)?life)\b",
            r"\bsuicide\s+(method|instruction|plan|note)s?\b",
            r"\bself[\s\-]harm\s+(technique|method|instruction|plan)\b",
            r"\b(i\s+want\s+to|i\s+will|i'm\s+going\s+to)\s+hurt\s+(my)?self\b",
            r"\b(want\s+to|going\s+to)\s+(harm|kill|hurt)\s+myself\b",
            r"\bhow\s+do\s+i\s+(commit\s+)?suicide\b",
            r"\bhow\s+to\s+(hurt|harm|kill)\s+myself\b",
            r"\b(best\s+)?(method|plan|guide|technique|instruction)s?\s+(for|of|to)\s+self[\s\-]?harm\b",
            r"\bself[\s\-]harm\s+plan\b",
            r"\bways?\s+to\s+(harm|hurt|injure)\s+(my)?self\b",
            r"\b(commit\s+suicide|go\s+commit\s+suicide)\b",
            r"\b(encourage|tell|convince|prompt|ask)\s+(me|someone|them|you|us)\s+to\s+(harm|hurt|kill|injure)\s+(my|your|them)?self\b",
        ],
    ),
    "sexual_content": (
        "critical",
        [
            r"\b(explicit|pornographic|nsfw|xxx)\s+(content|material|image|video)\b",
            r"\b(sexual|nude|naked)\s+(content|image|photo)\s+(of|featuring)\s+(minor|child|teen|kid)\b",
            r"\bchild\s+(pornography|sexual\s+abuse\s+material|csam)\b",
        ],
    ),
    "harassment": (
        "high",
        [
            r"\b(you\s+are|ur|you're|this\s+is|he\s+is|she\s+is)\s+(an?\s+)?(stupid|idiot|moron|retard|worthless|ugly|fat|disgusting|useless|pathetic|incompetent)\b",
            r"\b(i\s+will|gonna|going\s+to)\s+(find|hurt|kill|destroy|ruin)(\s+and\s+(hurt|kill|destroy|ruin))?\s+you\b",
            r"\bdox(xing)?\s+(someone|this\s+person|them|you)\b",
            r"\bi\s+hate\s+(everyone|you|this|these|those|all)\b",
            r"\b(completely|totally|absolutely)\s+useless\b",
            r"\beveryone\s+(is|are)\s+(worthless|stupid|idiot|useless|pathetic|garbage|trash)\b",
        ],
    ),
    "misinformation": (
        "high",
        [
            r"\b(vaccines?\s+(cause|causes?|caused?)\s+autism)\b",
            r"\b(covid|coronavirus)\s+(is|was)\s+(a\s+)?(hoax|fake|planned|engineered)\b",
            r"\b(5g\s+(causes?|spreads?|transmits?)\s+covid|coronavirus)\b",
        ],
    ),
    "illegal_activity": (
        "high",
        [
            r"\b(how\s+to|ways?\s+to|help\s+me)\s+(steal|rob|embezzle|launder|scam|defraud)\s+(\w+\s+)?(money|cash|funds?|bank|wallet|card)\b",
            r"\b(i\s+want\s+to|wanna|going\s+to|plan\s+to)\s+(steal|rob|embezzle|scam|defraud)\b",
            r"\bsteal\s+(bank|someone.{0,10}?)(money|cash|funds?|account|card)\b",
            r"\b(rob|robbing)\s+(a\s+)?(bank|store|person|someone)\b",
            r"\b(how\s+to|ways?\s+to)\s+(hack|break\s+into|bypass|crack)\s+(a\s+)?(bank|account|atm|credit\s+card|password)\b",
            r"\b(credit\s+card|card)\s+(fraud|skimming|clon(e|ing))\b",
            r"\b(money\s+launder(ing)?|tax\s+evasion\s+scheme|ponzi\s+scheme)\b",
            r"\b(how\s+to|steps?\s+to)\s+(make|synthesize|cook|manufacture)\s+(meth|heroin|fentanyl|cocaine|crack|mdma)\b",
            r"\b(buy|sell|deal|traffic)\s+(drugs?|narcotics?|meth|heroin|fentanyl|cocaine)\b",
        ],
    ),
}

#: Fixed values: (pattern, label, severity); case-blind, dot matches newlines.
UNSAFE_OUTPUT = [
    (r"(?i)\b(SELECT|INSERT|UPDATE|DELETE|DROP|ALTER|EXEC|UNION)\b.*\b(FROM|WHERE|TABLE|INTO|DATABASE)\b", "sql_query_in_output", "high"),
    (r"(?i)('\s*OR\s*'1'\s*=\s*'1|'\s*;\s*DROP\s+TABLE|1\s*=\s*1[\s;]*--|xp_cmdshell|'\s*OR\s*\d+\s*=\s*\d+)", "sql_injection_payload", "critical"),
    (r"<script[^>]*>.*?</script>", "xss_script_tag", "critical"),
    (r"(?i)javascript\s*:[^\s]", "xss_javascript_protocol", "high"),
    (r"(?i)on(load|click|error|mouseover|focus|blur)\s*=", "xss_event_handler", "high"),
    (r"\$\{[^}]+\}|\{\{[^}]+\}\}", "template_injection", "high"),
    (r"""(?i)fetch\s*\(?['\"]?https?://""", "js_fetch_exfil", "high"),
    (r"(?:;|\||&&|\$\(|`)\s*(?:rm|wget|curl|bash|sh|python|nc|netcat|ncat)\s", "shell_injection_payload", "critical"),
    (r"\$\([^)]+\)|`[^`]+`", "command_substitution", "high"),
    (r"(?:\.\./){2,}|(?:\.\.\\){2,}", "path_traversal", "high"),
    (r"(?i)/etc/(?:passwd|shadow|cron|crontab|sudoers|hosts|ssh)|/proc/self|C:\\Windows\\System32", "sensitive_path_reference", "critical"),
    (r"(?i)(?:http|ftp|file|dict|ldap|sftp|tftp)://(?:169\.254\.169\.254|127\.\d+\.\d+\.\d+|10\.\d+\.\d+\.\d+|172\.(?:1[6-9]|2\d|3[01])\.\d+\.\d+|192\.168\.\d+\.\d+)", "ssrf_internal_url", "critical"),
    (r"""(?i)(?:curl|wget|fetch)\s+['\"]?https?://[^'\">\s]+['\"]?\s+--data\b""", "data_exfiltration_pattern", "high"),
]

#: Fixed values: (pattern, weight); case-blind.
FABRICATION = [
    (r"\b(published|authored|written)\s+in\s+\d{4}\s+by\s+[A-Z][a-z]+\s+[A-Z][a-z]+", 0.6),
    (r"\baccording\s+to\s+(?:the\s+)?(?:study|research|paper|report)\s+(?:published|from)\s+(?:in\s+)?\d{4}", 0.5),
    (r"\bISBN\s*:?\s*[\d\-X]{10,17}", 0.7),
    (r"\bDOI\s*:?\s*10\.\d{4,}/\S+", 0.6),
    (r"\b(?:exactly|precisely)\s+\d+(?:\.\d+)?%\s+of\s+(?:people|users|cases|instances)", 0.5),
    (r"\b\d{1,3}(?:,\d{3})*\s+(?:people|individuals|cases)\s+(?:died|were killed|were affected)", 0.55),
]

#: Fixed values: (pattern, weight); case-blind.
OVERCONFIDENCE = [
    (r"\bthe\s+(?:answer|fact|truth|reality)\s+is\s+(?:definitively|absolutely|certainly)", 0.4),
    (r"\b(?:I\s+can\s+confirm|I\s+guarantee|I\s+assure\s+you)\s+that\b", 0.35),
    (r"\b100%\s+(?:accurate|correct|certain|sure|guaranteed)\b", 0.5),
    (r"\bno\s+(?:doubt|question)\s+(?:about\s+it|that)\b", 0.3),
]

#: Hedging patterns; case-blind.
HEDGES = [
    r"\b(I|i)\s+(think|believe|assume|suppose|reckon|imagine)",
    r"\b(might|may|could|can|should)\s+(be|have|indicate)",
    r"\b(probably|likely|possibly|perhaps|maybe|approximately|roughly|around|about)\b",
    r"\b(I'm|I am)\s+not\s+(sure|certain|confident|aware)",
    r"\b(to\s+my\s+knowledge|as\s+far\s+as\s+I\s+know|based\s+on\s+my\s+training)",
    r"\b(please\s+verify|you\s+should\s+check|I\s+recommend\s+confirming)",
    r"\b(I\s+don't\s+have|I\s+lack)\s+(access\s+to|information\s+about)",
    r"\bmy\s+(training\s+data|knowledge\s+cutoff|information)\s+(has|is\s+limited|may\s+be\s+outdated)",
]

#: Requests that invite invention; case-blind.
BAIT = [
    r"\bwhat\s+(?:is|are)\s+the\s+exact\s+(?:number|date|name|amount)\b",
    r"\b(?:cite|list|name)\s+(?:all|every)\s+(?:the\s+)?(?:studies|papers|sources|authors)\b",
    r"\bwhat\s+(?:did|does)\s+[A-Z][a-z]+\s+[A-Z][a-z]+\s+(?:say|write|publish)\s+(?:about|on)\b",
]

#: Topic: patterns; case-blind.
TOPICS = {
    "politics": [
        r"\b(election|vote|democrat|republican|liberal|conservative|president|congress|parliament|legislation|partisan)\b",
    ],
    "religion": [
        r"\b(god|allah|jesus|bible|quran|torah|hindu|buddhist|christian|muslim|jew(?:ish)?|atheist|religious)\b",
    ],
    "health_medical": [
        r"\b(diagnosis|prescri(?:ption|be)|medication|dosage|treat(?:ment)?|symptom|disease|cancer|HIV|vaccine)\b",
    ],
    "financial_advice": [
        r"\b(invest(?:ment)?|stock\s+tip|buy\s+shares|sell\s+shares|insider\s+trading|financial\s+advice|portfolio)\b",
    ],
    "legal_advice": [
        r"\b(legal\s+advice|sue|lawsuit|court\s+order|legal\s+liability|contract\s+law|attorney)\b",
    ],
    "violence": [
        r"\b(kill|murder|assault|weapon|bomb|terrorist|shoot|stab|attack)\b",
        r"\bbomb\s+blast\b",
        r"\b(terror(?:ist)?\s+attack|suicide\s+bomb|blow\s+up|detonate)\b",
    ],
    "drugs": [
        r"\b(cocaine|heroin|fentanyl|methamphetamine|overdose|narcotic|illicit\s+drug)\b",
    ],
}

#: Profane patterns; case-blind.
PROFANITY = [
    r"\bf+u+c+k+(?:ing|er|ed|s)?\b",
    r"\bs+h+i+t+(?:ty|ter|s)?\b",
    r"\ba+s+s+h+o+l+e+s?\b",
    r"\bb+i+t+c+h+(?:es|ing)?\b",
    r"\bc+u+n+t+s?\b",
    r"\bd+a+m+n+(?:it)?\b",
    r"\bh+e+l+l+\b",
    r"\bcrap\b",
    r"\bbastard\b",
    r"\bdick(?:head)?\b",
    r"\bprick\b",
    r"\bwh+o+r+e+s?\b",
    r"\bslut+s?\b",
    r"\bn+i+g+(?:g+a+|g+e+r+)\b",
    r"\bf+a+g+(?:g+o+t+s?)?\b",
]

#: Fixed values: (category, pattern); case-blind.
BIAS = [
    ("gender_bias", r"\b(men\s+are|women\s+are|boys\s+are|girls\s+are|(?:males?|females?)\s+(?:always|never|can'?t|are\s+(?:better|worse|inferior|superior)))\b"),
    ("age_bias", r"\b(old(?:er)?\s+people\s+(?:can'?t|always|never)|millennials?\s+(?:are\s+)?(?:lazy|entitled)|boomers?\s+(?:are|always))\b"),
    ("ethnic_bias", r"\b((?:black|white|asian|hispanic|latino|arab|jewish)\s+people\s+(?:always|never|are\s+(?:all|lazy|criminal|violent)))\b"),
    ("religious_bias", r"\b((?:muslims?|christians?|jews?|hindus?|atheists?)\s+(?:always|never|are\s+(?:all|bad|violent|terrorists?)))\b"),
    ("disability_bias", r"\b((?:disabled|handicapped|retarded|crazy|insane)\s+people\s+(?:can'?t|always|are))\b"),
]

#: Names that competitor_check looks for by default.
COMPETITORS = ["OpenAI", "ChatGPT", "GPT-4", "GPT-3", "Anthropic", "Claude", "Google", "Gemini", "Bard", "Microsoft", "Copilot", "Bing", "Meta", "LLaMA", "Llama", "Mistral", "Cohere", "AI21", "Hugging Face", "Stability AI"]
