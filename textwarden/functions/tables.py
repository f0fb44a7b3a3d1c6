"""Static dimensions of the compliance roll-ups and the catalogue of checks: tables only."""

from __future__ import annotations

#: Fixed values: (id, name, weight).
OWASP = [
    ("LLM01", "Prompt Injection", 1.0),
    ("LLM02", "Insecure Output Handling", 0.95),
    ("LLM03", "Training Data Poisoning", 0.85),
    ("LLM04", "Model Denial of Service", 0.7),
    ("LLM05", "Supply Chain Vulnerabilities", 0.8),
    ("LLM06", "Sensitive Information Disclosure", 0.9),
    ("LLM07", "Insecure Plugin Design", 0.85),
    ("LLM08", "Excessive Agency", 0.88),
    ("LLM09", "Overreliance / Hallucination", 0.82),
    ("LLM10", "Model Theft", 0.75),
]

#: Fixed values: (article, title, evidence asked for, checks that give it; * is all).
EU_ARTICLES = [
    ("Article 9", "Risk Management System", ["Risk identification logs", "Risk mitigation measures documentation", "Residual risk assessment"], ["prompt_injection", "toxicity", "hallucination_risk", "insecure_output"]),
    ("Article 10", "Data and Data Governance", ["Data source documentation", "PII scan results", "Data quality metrics"], ["pii_detection"]),
    ("Article 12", "Record-Keeping", ["Audit log with timestamps", "Input/output logs", "Incident records", "Decision traces"], ["*"]),
    ("Article 13", "Transparency and Provision of Information", ["Hallucination risk scores per response", "Confidence indicators", "Capability and limitation documentation"], ["hallucination_risk", "pii_detection", "toxicity"]),
    ("Article 14", "Human Oversight", ["Human review triggers log", "Override event records", "High-risk decision escalation records"], ["hallucination_risk", "toxicity", "prompt_injection"]),
    ("Article 15", "Accuracy, Robustness and Cybersecurity", ["Accuracy benchmarks", "Adversarial robustness test results", "Prompt injection test results", "Security scan reports"], ["prompt_injection", "insecure_output"]),
    ("Article 17", "Quality Management System", ["Continuous monitoring records", "Incident response documentation", "Post-market surveillance logs"], ["*"]),
]

#: Fixed values: (function, subcategories, checks; * is all).
NIST_FUNCTIONS = [
    ("GOVERN", ["GV-1.1", "GV-1.2", "GV-4.1"], ["*"]),
    ("MAP", ["MP-2.1", "MP-2.3", "MP-5.1"], ["prompt_injection", "pii_detection", "toxicity", "hallucination_risk"]),
    ("MEASURE", ["MS-1.1", "MS-2.1", "MS-2.5", "MS-2.6"], ["prompt_injection", "pii_detection", "toxicity", "hallucination_risk", "insecure_output"]),
    ("MANAGE", ["MG-1.1", "MG-2.2", "MG-3.1", "MG-4.1"], ["*"]),
]

#: Maturity levels.
MATURITY = {1: "Initial", 2: "Managed", 3: "Defined", 4: "Optimizing"}

#: Fixed values: (id, name, infrastructure, risk categories, use cases, content types, OWASP references, EU references).
CATALOGUE = [
    ("prompt_injection", "Prompt Injection Detector", "RULE", ["JAILBREAKING", "BRAND RISK"], ["CHATBOTS", "CUSTOMER SUPPORT", "RAG", "AGENTS"], ["STRING"], ["LLM01"], ["Article 9", "Article 15"]),
    ("pii_detector", "PII Detector", "RULE", ["DATA LEAKAGE"], ["CHATBOTS", "CUSTOMER SUPPORT", "RAG", "SUMMARIZATION"], ["STRING"], ["LLM06"], ["Article 10", "Article 13"]),
    ("toxic_language", "Toxic Language", "RULE", ["ETIQUETTE", "BRAND RISK"], ["CHATBOTS", "CUSTOMER SUPPORT", "TEXT2SQL"], ["STRING"], ["LLM08"], ["Article 9"]),
    ("hallucination_risk", "Hallucination Risk Scorer", "RULE", ["FACTUALITY"], ["RAG", "SUMMARIZATION", "CHATBOTS"], ["STRING"], ["LLM09"], ["Article 13", "Article 17"]),
    ("insecure_output", "Insecure Output Detector", "RULE", ["CODE EXPLOITS", "BRAND RISK"], ["CODEGEN", "TEXT2SQL", "AGENTS"], ["STRING", "CODE", "SQL"], ["LLM02"], ["Article 15"]),
    ("prompt_injection_ml", "Prompt Injection (ML)", "ML", ["JAILBREAKING"], ["CHATBOTS", "RAG", "AGENTS"], ["STRING"], ["LLM01"], ["Article 9"]),
    ("granite_hap", "Granite HAP (Hate, Abuse, Profanity)", "ML", ["ETIQUETTE"], ["CHATBOTS", "CUSTOMER SUPPORT"], ["STRING"], ["LLM08"], ["Article 9"]),
    ("granite_guardian", "Granite Guardian", "ML", ["JAILBREAKING", "DATA LEAKAGE", "ETIQUETTE"], ["CHATBOTS", "RAG", "AGENTS"], ["STRING"], ["LLM01", "LLM06", "LLM08"], ["Article 9", "Article 10", "Article 13"]),
    ("semantic_similarity", "Semantic Similarity Check", "ML", ["FACTUALITY"], ["RAG", "SUMMARIZATION"], ["STRING"], ["LLM09"], ["Article 13"]),
    ("llm_intent", "LLM Intent Classifier", "LLM", ["JAILBREAKING", "BRAND RISK"], ["CHATBOTS", "CUSTOMER SUPPORT"], ["STRING"], ["LLM01", "LLM07"], ["Article 9"]),
    ("local_intent", "Local Intent Classifier", "RULE", ["JAILBREAKING", "ETIQUETTE"], ["CHATBOTS", "CUSTOMER SUPPORT"], ["STRING"], ["LLM07"], ["Article 9"]),
    ("valid_json", "Valid JSON", "RULE", ["FORMATTING"], ["CODEGEN", "RAG", "CHATBOTS"], ["STRING"], [], []),
    ("valid_html", "Valid HTML", "RULE", ["FORMATTING"], ["CODEGEN", "CHATBOTS"], ["STRING"], [], []),
    ("valid_sql", "Valid SQL", "RULE", ["FORMATTING", "CODE EXPLOITS"], ["TEXT2SQL", "CODEGEN"], ["SQL", "STRING"], ["LLM02"], []),
    ("valid_python", "Valid Python", "RULE", ["FORMATTING"], ["CODEGEN"], ["CODE", "STRING"], [], []),
    ("valid_url", "Valid URL", "RULE", ["FORMATTING"], ["CHATBOTS", "RAG"], ["STRING"], [], []),
    ("valid_length", "Valid Length", "RULE", ["FORMATTING"], ["CHATBOTS", "SUMMARIZATION"], ["STRING"], [], []),
    ("valid_choices", "Valid Choices", "RULE", ["FORMATTING"], ["CHATBOTS", "AGENTS"], ["STRING"], [], []),
    ("regex_match", "Regex Match", "RULE", ["FORMATTING"], ["CHATBOTS", "CODEGEN"], ["STRING"], [], []),
    ("contains_string", "Contains String", "RULE", ["FORMATTING"], ["CHATBOTS", "RAG"], ["STRING"], [], []),
    ("ends_with", "Ends With", "RULE", ["FORMATTING"], ["CHATBOTS"], ["STRING"], [], []),
    ("one_line", "One Line", "RULE", ["FORMATTING"], ["CHATBOTS", "SUMMARIZATION"], ["STRING"], [], []),
    ("reading_time", "Reading Time", "RULE", ["FORMATTING"], ["CHATBOTS", "SUMMARIZATION"], ["STRING"], [], []),
    ("uppercase", "Uppercase", "RULE", ["FORMATTING"], ["CHATBOTS"], ["STRING"], [], []),
    ("lowercase", "Lowercase", "RULE", ["FORMATTING"], ["CHATBOTS"], ["STRING"], [], []),
    ("two_words", "Two Words", "RULE", ["FORMATTING"], ["CHATBOTS"], ["STRING"], [], []),
    ("competitor_check", "Competitor Check", "RULE", ["BRAND RISK"], ["CHATBOTS", "CUSTOMER SUPPORT"], ["STRING"], ["LLM09"], []),
    ("ban_list", "Ban List", "RULE", ["BRAND RISK", "ETIQUETTE"], ["CHATBOTS", "CUSTOMER SUPPORT"], ["STRING"], ["LLM08"], []),
    ("redundant_sentences", "Redundant Sentences", "RULE", ["ETIQUETTE"], ["SUMMARIZATION", "CHATBOTS"], ["STRING"], [], []),
    ("sensitive_topic", "Sensitive Topic", "RULE", ["ETIQUETTE", "BRAND RISK"], ["CHATBOTS", "CUSTOMER SUPPORT"], ["STRING"], ["LLM08"], ["Article 9"]),
    ("profanity_free", "Profanity Free", "RULE", ["ETIQUETTE"], ["CHATBOTS", "CUSTOMER SUPPORT"], ["STRING"], ["LLM08"], []),
    ("bias_check", "Bias Check", "RULE", ["BRAND RISK", "ETIQUETTE"], ["CHATBOTS", "CUSTOMER SUPPORT", "RAG"], ["STRING"], ["LLM08"], ["Article 9", "Article 10"]),
    ("reading_level", "Reading Level", "RULE", ["ETIQUETTE"], ["CHATBOTS", "SUMMARIZATION"], ["STRING"], [], ["Article 13"]),
]

#: What the live roll-up counts: (check, OWASP id), and (article, checks).
LIVE_OWASP = [("prompt_injection", "LLM01"), ("pii_detection", "LLM06"), ("toxicity", "LLM02"), ("hallucination_risk", "LLM09"), ("insecure_output", "LLM02")]
LIVE_EU = [("Article 9", ["prompt_injection", "toxicity"]), ("Article 10", ["pii_detection"]), ("Article 12", []), ("Article 13", ["hallucination_risk", "pii_detection", "toxicity"]), ("Article 14", []), ("Article 15", ["prompt_injection", "insecure_output"]), ("Article 17", [])]
