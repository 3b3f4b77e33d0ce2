"""Word lists and patterns. All are defaults of parameters."""

# They must be these for equal results.
STOPWORDS = (
    "the", "a", "an", "and", "or", "but", "in", "on", "at", "to", "for", "of", "with", "by", "from", "is", "was", "are", "were", "be", "been",
    "being", "have", "has", "had", "do", "does", "did", "will", "would", "could", "should", "may", "might", "must", "shall", "can",
    "this", "that", "these", "those", "it", "its", "as", "not",
)
BOOSTED = (
    "diagnosis", "treatment", "symptoms", "medication", "dosage", "therapy", "patient", "clinical", "disease", "syndrome", "disorder", "condition",
    "laboratory", "imaging", "biopsy", "pathology", "prognosis", "contraindication", "adverse", "efficacy", "protocol", "guideline",
)
PRIORITY_TERMS = (
    "clinical trial", "randomized controlled", "meta-analysis", "systematic review", "evidence-based", "guidelines", "recommendation", "contraindicated",
    "drug interaction", "adverse effect", "side effect", "mechanism of action", "pathophysiology", "etiology", "prognosis", "mortality", "morbidity",
    "sensitivity", "specificity", "positive predictive", "negative predictive", "first-line", "second-line", "standard of care", "treatment protocol",
)
NEGATIVE_TERMS = ("disclaimer", "not medical advice", "consult your doctor", "this information is for educational", "general information only")
VALUED_SECTIONS = ("results", "conclusion", "findings", "assessment", "methods")
VALUED_TYPES = ("research_paper", "medical_guideline", "clinical_note")
UNCERTAINTY_PHRASES = (
    "i don't know", "i am not sure", "i cannot", "no information", "not found", "unable to", "insufficient", "context does not",
    "cannot determine", "no relevant", "based on my training", "as an ai", "i'm not able",
)
ANCHOR_PHRASES = (
    "according to", "the study shows", "evidence indicates", "guidelines recommend", "research demonstrates", "clinical trials",
    "the findings", "data suggests", "results show",
)
HEDGE_PHRASES = ("may", "might", "could", "possibly", "potentially", "appears", "seems", "likely", "unlikely", "suggests", "estimated")
DEFINITIVE_MARKERS = ("is", "are", "was", "were", "has been", "have been")
CONTRADICTIONS = (
    (r"\bis\b", r"\bis not\b"), (r"\beffective\b", r"\bineffective\b"), (r"\bincreases?\b", r"\bdecreases?\b"),
    (r"\brecommended\b", r"\bnot recommended\b"), (r"\bindicated\b", r"\bcontraindicated\b"),
)
NUMERIC_CLAIM = r"\b\d+(?:\.\d+)?(?:\s*-\s*\d+(?:\.\d+)?)?\s*(?:%|mg|mcg|g|ml|mmhg|mmol|ng|pg|iu|units?|hours?|days?|weeks?|months?|years?)\b"
CLAIM_PATTERNS = (
    r"\b\d+(?:\.\d+)?%\s+(?:of\s+patients?|survival|mortality|sensitivity|specificity)\b",
    r"\b(?:dose|dosage)\s+(?:of|is|:)?\s*\d+\s*(?:mg|mcg|ug|g|units?|iu)\b",
    r"\b(?:half.life|t1/2)\s+(?:of|is)?\s*\d+\s*(?:hours?|days?|minutes?|weeks?)\b",
    r"\b\d+\s*(?:mg|mcg|g|ml|units?|iu)\s*(?:per|/)\s*(?:day|kg|dose|hour)\b",
    r"\b(?:sensitivity|specificity|ppv|npv)\s+(?:of|is|:)?\s*\d+(?:\.\d+)?%?\b",
    r"\bgrade\s+[1-4ivIV]+\b", r"\bstage\s+[1-4ivIV]+[abcABC]?\b", r"\bclass\s+[1-4ivIV]+\b",
    r"\bnormal\s+(?:range|value)\s+(?:is|of|:)?\s*[\d.,\-]+\b",
)
DOCUMENT_TYPES = {
    "research_paper": (r"\babstract\b", r"\bintroduction\b", r"\bmethods?\b", r"\bresults?\b", r"\bdiscussion\b", r"\bconclusion\b", r"\breferences\b", r"\bdoi\b", r"\bjournal\b", r"\bpublished\b", r"\bcited by\b"),
    "clinical_note": (r"\bpatient\b", r"\bchief complaint\b", r"\bhistory of present illness\b", r"\bphysical examination\b", r"\bassessment\b", r"\bplan\b", r"\bmedications?\b", r"\ballergies\b", r"\bvital signs\b", r"\bdiagnosis\b", r"\bfollow.?up\b"),
    "lab_report": (r"\blab(?:oratory)? results?\b", r"\btest results?\b", r"\bnormal range\b", r"\breference range\b", r"\bspecimen\b", r"\bcollected\b", r"\bcbc\b", r"\bwbc\b", r"\brbc\b", r"\bglucose\b", r"\bcreatinine\b", r"\bhmg\b", r"\bplt\b"),
    "medical_guideline": (r"\bguideline\b", r"\brecommendation\b", r"\bevidence.?based\b", r"\bgrade [abcd]\b", r"\bstrong recommendation\b", r"\bconditional\b", r"\bclinical practice\b", r"\bstandard of care\b"),
    "radiology_report": (r"\bfinding\b", r"\bimpression\b", r"\bradiology\b", r"\bimaging\b", r"\bmri\b", r"\bct scan\b", r"\bx.?ray\b", r"\bultrasound\b", r"\bcontrast\b", r"\bnodule\b", r"\blesion\b"),
    "discharge_summary": (r"\bdischarge\b", r"\badmission\b", r"\bhospital\b", r"\bdischarge diagnosis\b", r"\bdischarge medications?\b", r"\bfollow.?up instructions?\b"),
}
SPECIALTIES = (
    "cardiology", "oncology", "neurology", "orthopedics", "radiology", "pathology", "psychiatry", "endocrinology", "gastroenterology",
    "pulmonology", "nephrology", "rheumatology", "hematology", "infectious", "pediatrics", "geriatrics", "obstetrics", "gynecology", "urology",
    "dermatology", "ophthalmology", "ent", "emergency", "surgery",
)
SECTION_NAMES = {
    "abstract": r"abstract|summary", "introduction": r"introduction|background|overview", "methods": r"methods?|methodology|materials? and methods?",
    "results": r"results?|findings?|outcomes?", "discussion": r"discussion|analysis", "conclusion": r"conclusions?|concluding remarks",
    "references": r"references?|bibliography|citations?", "history": r"history|hpi|history of present illness", "examination": r"physical exam|examination|pe",
    "assessment": r"assessment|impression|diagnosis", "plan": r"plan|treatment|management|recommendations?", "medications": r"medications?|current medications?|drug list",
    "labs": r"laboratory|lab results?|labs?", "imaging": r"imaging|radiology|radiologic findings?",
}
SECTION_HEADERS = (
    r"^\s{0,4}(?:ABSTRACT|INTRODUCTION|BACKGROUND|METHODS?|RESULTS?|DISCUSSION|CONCLUSION|REFERENCES?)\s*$",
    r"^\s{0,4}(?:Chief Complaint|History of Present Illness|Physical Examination|Assessment|Plan|Medications?|Allergies|Vital Signs)\s*:?\s*$",
    r"^\s{0,4}(?:Findings?|Impression|Clinical History|Laboratory Results?)\s*:?\s*$",
    r"^#{1,3}\s+", r"^\d+\.\s+[A-Z]",
)
AUTHOR_PATTERNS = (
    r"(?:authors?|by)\s*:?\s*([A-Z][a-z]+ [A-Z][a-z]+(?:,\s*[A-Z][a-z]+ [A-Z][a-z]+)*)",
    r"^([A-Z][a-z]+ [A-Z][a-z]+(?:,\s*[A-Z][a-z]+ [A-Z][a-z]+){1,5})\s*$",
)
JOURNAL_PATTERNS = (
    r"(?:journal|published in|in)\s*:?\s*([A-Z][A-Za-z\s&]+(?:Journal|Medicine|Review|Research|Science|Health))",
    r"([A-Z][A-Za-z\s]+(?:Journal|Medicine|Review|Research))\s*\d{4}",
)
MODALITIES = {
    "xray": ("x-ray", "xray", "x ray", "radiograph", "chest pa", "chest ap", "plain film", "kv", "mas", "bone", "lung", "rib", "spine", "anteroposterior", "posteroanterior"),
    "ct": ("ct scan", "computed tomography", "computed tomograph", "hounsfield", "hu ", "axial", "coronal", "sagittal", "contrast enhanced", "non-contrast", "slice thickness", "window width", "window level", "helical"),
    "mri": ("mri", "magnetic resonance", "t1", "t2", "flair", "dwi", "adc", "t1w", "t2w", "gadolinium", "tesla", "tr ", "te ", "field strength", "proton density", "bold", "diffusion weighted"),
    "ultrasound": ("ultrasound", "sonogram", "sonography", "echogenicity", "hyperechoic", "hypoechoic", "anechoic", "doppler", "transducer", "mhz", "probe", "acoustic shadow", "echocardiography"),
    "pathology": ("pathology", "histology", "biopsy", "hematoxylin", "eosin", "h&e", "stain", "magnification", "cells", "tissue", "nucleus", "cytology", "immunohistochemistry", "ihc", "microscopy", "section"),
    "chart": ("figure", "fig.", "graph", "chart", "plot", "diagram", "curve", "kaplan", "survival", "forest plot", "odds ratio", "hazard", "bar graph", "histogram", "scatter"),
    "clinical": ("clinical photo", "wound", "skin", "lesion", "rash", "swelling", "erythema", "dermato", "photograph", "clinical image", "patient photo"),
}
REGIONS = {
    "xray": ("chest", "abdomen", "pelvis", "spine", "extremity", "skull", "knee", "hip", "shoulder", "wrist"),
    "ct": ("head", "chest", "abdomen", "pelvis", "spine", "neck", "extremity", "whole body"),
    "mri": ("brain", "spine", "knee", "shoulder", "hip", "abdomen", "pelvis", "breast", "heart"),
    "ultrasound": ("abdomen", "pelvis", "thyroid", "breast", "cardiac", "vascular", "obstetric", "renal"),
    "pathology": ("lung", "colon", "breast", "prostate", "liver", "kidney", "skin", "lymph node", "brain"),
    "chart": ("statistical", "survival", "clinical outcome", "treatment comparison"),
    "clinical": ("skin", "wound", "extremity", "face", "oral", "eye", "ear", "neck"),
}
# What is done to a picture of each kind.
PREPARATION = {
    "xray": ("enhance_contrast", "denoise", "normalize", "clahe"), "ct": ("denoise", "normalize", "clahe"), "mri": ("denoise", "normalize"),
    "ultrasound": ("enhance_contrast", "denoise", "normalize"), "pathology": ("enhance_contrast",), "chart": (), "clinical": ("enhance_contrast",),
}
