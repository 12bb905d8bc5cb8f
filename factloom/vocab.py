"""Controlled vocabularies of the evidence rules.

Fixed values: results depend on every entry, so the lists are stated as they must be.
"""

# Canonical section names and their headings.
SECTION_ALIASES = {
    "abstract": ["abstract"],
    "introduction": ["introduction", "background"],
    "methods": ["methods", "materials and methods", "method", "patients and methods"],
    "results": ["results"],
    "discussion": ["discussion", "conclusions", "conclusion"],
}

# Sections without facts, the shortest section worth reading, the longest that is read.
SKIPPED_SECTIONS = ["references", "funding", "author information", "conflict", "acknowledgment"]
MIN_SECTION_CHARS, MAX_SECTION_CHARS = 50, 4000

# Spellings of conditions and what they are written as.
CANONICAL_CONDITIONS = {
    "anxious depression": "depression",
    "major depression": "major depressive disorder",
    "treatment resistant depression": "treatment-resistant depression",
    "treatment-resistant depression": "treatment-resistant depression",
    "trd": "treatment-resistant depression",
    "mdd": "major depressive disorder",
    "gad": "generalized anxiety disorder",
    "social anxiety disorder": "social anxiety",
    "ptsd": "post-traumatic stress disorder",
    "ocd": "obsessive compulsive disorder",
    "bipolar i disorder": "bipolar disorder",
    "bipolar ii disorder": "bipolar disorder",
}

# What extraction does not accept as a side effect.
INVALID_SIDE_EFFECTS = [
    "side effect frequency", "adverse event", "adverse events", "side effects", "adverse effect", "adverse effects",
    "effect", "outcome", "symptom", "symptoms", "placebo", "response", "remission", "improvement",
]

# Words that put a condition into context.
CLINICAL_CONTEXT = [
    "treat", "therapy", "improvement", "remission", "response", "efficacy", "symptom", "disorder", "disease", "syndrome",
    "adverse", "side effect", "tolerated", "managed", "controlled",
]
# The lines of treatment that a fact may name.
TREATMENT_LINES = ["first", "second", "maintenance", "acute"]
# Pronouns that leave a span without its subject.
PRONOUNS = ["it", "this", "that", "these", "they", "those", "which"]
# The verbs that make such a span dangle.
PRONOUN_VERBS = ["showed", "demonstrated", "resulted", "found"]

# Conditions known to validation.
VALID_CONDITIONS = [
    "depression", "major depressive disorder", "major depression", "treatment-resistant depression",
    "persistent depressive disorder", "dysthymia", "depressive disorder",
    "anxiety", "generalized anxiety disorder", "gad", "panic disorder", "social anxiety", "social anxiety disorder",
    "phobia", "anxiety disorder", "separation anxiety",
    "ptsd", "post-traumatic stress disorder", "trauma", "acute stress disorder",
    "bipolar disorder", "bipolar i", "bipolar ii", "bipolar disorder i", "bipolar disorder ii",
    "schizophrenia", "schizoaffective disorder", "psychosis", "brief psychotic disorder",
    "adhd", "attention deficit hyperactivity disorder", "autism spectrum disorder", "asd", "autism", "add",
    "attention deficit disorder",
    "obsessive compulsive disorder", "ocd", "body dysmorphic disorder", "bdd",
    "eating disorders", "anorexia", "anorexia nervosa", "bulimia", "bulimia nervosa", "binge eating disorder", "bing eating",
    "substance use disorder", "alcohol use disorder", "opioid use disorder", "drug abuse", "substance abuse", "addiction",
    "insomnia", "sleep disorder", "narcolepsy", "sleep apnea",
    "adjustment disorder", "oppositional defiant disorder", "odd", "conduct disorder", "personality disorder",
    "borderline personality disorder", "bpd", "antisocial personality disorder",
]

# Words that no condition contains.
CONDITION_EXCLUSIONS = [
    "treatment", "therapy", "medication", "drug", "intervention", "approach", "method", "technique", "procedure",
    "protocol", "regimen", "strategy", "care", "management", "typical medical treatment", "standard care", "placebo",
    "control", "baseline", "comparison", "comparator",
]

# Parts of known treatment names.
DRUG_PATTERNS = [
    "sertraline", "fluoxetine", "paroxetine", "escitalopram", "citalopram", "fluvoxamine",
    "venlafaxine", "duloxetine", "desvenlafaxine", "levomilnacipran",
    "bupropion", "mirtazapine", "trazodone", "nefazodone",
    "phenelzine", "tranylcypromine", "isocarboxazid", "selegiline",
    "amitriptyline", "imipramine", "nortriptyline", "desipramine",
    "buspirone", "hydroxyzine", "propranolol",
    "lamottal", "lamotrigine", "valproate", "lithium", "divalproex",
    "clozapine", "risperidone", "olanzapine", "quetiapine", "aripiprazole", "haloperidol",
    "ssri", "ssris", "selective serotonin reuptake inhibitor", "snri", "snris", "tricyclic", "tricyclics", "maoi", "maois",
    "antidepressant", "antidepressants",
    "cbt", "cognitive behavioral therapy", "psychotherapy", "ect", "tms", "vns", "mindfulness", "meditation", "exercise",
]

# The relations and the labels of their edges.
RELATION_LABELS = {
    "TREATS": "treats",
    "IMPROVES": "improves",
    "ASSOCIATED_WITH_SE": "associated_with_side_effect",
    "AUGMENTS": "augments",
    "CONTRAINDICATED_FOR": "contraindicated_for",
    "SUPERIOR_TO": "superior_to",
    "EQUIVALENT_TO": "equivalent_to",
    "INFERIOR_TO": "inferior_to",
    "PREVENTS_RELAPSE_IN": "prevents_relapse_in",
    "FIRST_LINE_FOR": "first_line_for",
    "MAINTENANCE_FOR": "maintenance_for",
    "WELL_TOLERATED_IN": "well_tolerated_in",
    "EFFECTIVE_IN_SUBGROUP": "effective_in_subgroup",
}
RELATIONS = list(RELATION_LABELS)

# Side effects known to validation.
COMMON_SIDE_EFFECTS = [
    "nausea", "headache", "dizziness", "fatigue", "insomnia", "somnolence", "dry mouth", "constipation", "diarrhea",
    "sexual dysfunction", "weight gain", "weight loss", "tremor", "sweating", "blurred vision", "anxiety", "agitation",
    "akathisia", "restlessness", "sedation", "drowsiness", "tachycardia", "palpitations", "hypertension", "hypotension",
    "nausea and vomiting", "loss of appetite", "increased appetite", "insomnia and anxiety", "sleep disturbance",
    "vivid dreams", "nightmares", "sexual dysfunction and decreased libido", "erectile dysfunction", "decreased libido",
    "discontinuation syndrome", "withdrawal symptoms", "serotonin syndrome", "hyponatremia", "liver enzyme elevation",
    "qc prolongation", "torsades de pointes",
]

# Names that stand for no drug, and names too general.
PLACEHOLDER_DRUGS = ["n/a", "na", "none", "unknown", "not specified", "not available"]
GENERIC_DRUGS = [
    "switching options", "augmentation options", "treatment options", "medication", "medications", "therapy", "therapies",
    "intervention", "treatment", "treatments", "drug", "drugs", "antidepressant options",
]

# Outcomes and symptoms that are no conditions.
OUTCOME_WORDS = ["remission", "response", "improvement", "outcome", "result", "change", "reduction", "recovery", "symptom remission"]
ISOLATED_SYMPTOMS = [
    "insomnia", "nervousness", "agitation", "physical symptoms", "insomnia and nervousness", "insomnia and agitation",
    "fatigue", "headache", "nausea", "dizziness", "pain", "anxiety symptoms", "depressive symptoms",
]
# Statistics that an effect size may name instead of a number.
EFFECT_STATISTICS = ["cohen", "nnt", "odds ratio", "hazard ratio"]

# Fixed values of the strict profile: filler words, and the language of comparisons.
FILLER_WORDS = ["with", "and", "the", "for", "of", "in", "or", "a", "an"]
COMPARISON_LANGUAGE = {
    "SUPERIOR_TO": ["worse than", "lower than", "less than", "less effective", "not better", "inferior", "poorer", "not as effective"],
    "INFERIOR_TO": ["better than", "superior", "more effective", "higher than", "greater than", "outperform", "surpass"],
    "EQUIVALENT_TO": ["similar", "equivalent", "comparable", "same as", "as effective", "not better", "no difference", "equally"],
}

# Fixed values of the quality rules.
RELATION_KEYWORDS = {
    "TREATS": ["treat", "treatment", "effective", "efficacy", "therapy"],
    "IMPROVES": ["improve", "better", "enhance", "increase", "reduce"],
    "ASSOCIATED_WITH_SE": ["side effect", "adverse", "tolera", "experience"],
    "EQUIVALENT_TO": ["similar", "equivalent", "not better", "no difference", "comparable"],
    "SUPERIOR_TO": ["better than", "superior", "more effective", "outperform"],
}
TREATMENT_WORDS = ["treatment", "therapy", "medication", "drug", "care"]
KNOWN_PAIRS = [
    ("sertraline", "depression", "TREATS"),
    ("fluoxetine", "depression", "TREATS"),
    ("escitalopram", "anxiety", "TREATS"),
    ("ssri", "depression", "TREATS"),
    ("ssris", "depression", "TREATS"),
]
