"""Word lists, lookup tables and patterns. All are parameters of the operators; these are the defaults."""

from __future__ import annotations

# Terms of the document glossary.
GLOSSARY = [
    "aluminum", "assembly", "casting", "composite", "cycle time", "fastener", "fixture", "forging", "inspection", "machining",
    "plastic", "specification", "stainless steel", "stamping", "steel", "surface finish", "tolerance", "welding",
]

# Keyword categories for vector features.
FEATURE_KEYWORDS = {
    "processes": ["machining", "molding", "injection", "casting", "assembly", "welding", "stamping"],
    "materials": ["steel", "aluminum", "plastic", "polymer", "composite", "alloy", "titanium"],
    "specifications": ["tolerance", "dimension", "thickness", "diameter", "radius", "clearance"],
    "quality": ["specification", "requirement", "standard", "minimum", "maximum", "shall", "must"],
    "measurements": ["mm", "inch", "cm", "meter", "degree", "micron", "surface finish"],
}

# Terms that mark a sentence or chunk as worth reading, processes, materials and dimensions.
PRIORITY_TERMS = [
    "minimum", "maximum", "thickness", "diameter", "radius", "tolerance", "clearance", "specification", "requirement", "standard", "shall",
    "must", "required", "not less than", "not exceed", "between",
]
PROCESS_TERMS = ["machining", "molding", "assembly", "welding", "casting", "sheet metal", "injection", "drilling", "milling", "turning"]
MATERIAL_TERMS = ["steel", "aluminum", "plastic", "carbon", "titanium", "copper", "stainless", "alloy", "composite", "polymer"]
DIMENSION_TERMS = ["length", "width", "height", "depth", "angle", "surface finish", "roughness", "flatness", "roundness", "concentricity"]
CHUNK_TERMS = [*PRIORITY_TERMS, *PROCESS_TERMS, *MATERIAL_TERMS, *DIMENSION_TERMS]
MODALS = [" shall ", " must ", " should "]
# Unit substrings of the sentence heuristic.
UNITS = ["mm", "cm", "inch", "inches", "kg", "g"]

#: A lexicon that occurs in the driver's documents.
DATA_TERMS = ["the", "and", "thon", "mit", "license", "apache", "token"]
DATA_PRIORITY = ["license", "token", "thon", "apache"]

# Stop words of the phrase extractor.
STOPWORDS = [
    "the", "a", "an", "and", "or", "but", "if", "while", "at", "by", "for", "with", "about", "against", "between", "into",
    "through", "during", "before", "after", "above", "below", "to", "from", "up", "down", "in", "out", "on", "off", "over",
    "under", "again", "further", "then", "once", "here", "there", "when", "where", "why", "how", "all", "any", "both", "each",
    "few", "more", "most", "other", "some", "such", "no", "nor", "not", "only", "own", "same", "so", "than", "too", "very",
    "can", "will", "just", "should", "now", "of", "is", "are", "was", "were", "be", "been", "being", "have", "has", "had", "do",
    "does", "did", "doing",
]

#: English function words that no search looks for: those above, pronouns, auxiliaries and a few adverbs.
ENGLISH = [
    *STOPWORDS,
    "i", "me", "my", "myself", "we", "us", "our", "ours", "ourselves", "you", "your", "yours", "yourself", "yourselves", "he", "him", "his",
    "himself", "she", "her", "hers", "herself", "it", "its", "itself", "they", "them", "their", "theirs", "themselves", "what", "which",
    "who", "whom", "whose", "this", "that", "these", "those", "am", "having", "could", "may", "might", "must", "would", "shall", "cannot", "as",
    "until", "because", "since", "though", "although", "however", "also", "yet", "still", "thus", "therefore", "else", "either", "neither",
    "among", "within", "without", "upon", "onto", "via", "per", "one", "another", "every", "many", "much", "several", "always", "never", "often",
]

# Rule types, and names that stand for them.
RULE_TYPES = ["dimensional", "material", "process", "quality", "safety", "assembly", "tolerance", "general"]
RULE_TYPE_ALIASES = {
    "dimensional specification": "dimensional",
    "material specification": "material",
    "process specification": "process",
    "quality specification": "quality",
    "safety requirement": "safety",
    "design specification": "general",
    "design requirement": "general",
    "proportional specification": "dimensional",
}

# Rule categories, and substrings that stand for them, in order.
CATEGORIES = [
    "Sheet Metal", "Injection Molding", "Machining", "Assembly", "Welding", "Casting", "Quality Control", "Electronics",
    "Material Specification", "Safety Requirement", "Design Guideline", "General",
]
CATEGORY_PARTS = {
    "pharmaceutical": "Quality Control",
    "pharma": "Quality Control",
    "quality control": "Quality Control",
    "occupational health and safety": "Safety Requirement",
    "occupational health & safety": "Safety Requirement",
    "occupational safety": "Safety Requirement",
    "safety": "Safety Requirement",
    "health and safety": "Safety Requirement",
    "material": "Material Specification",
    "materials": "Material Specification",
    "assembly": "Assembly",
    "machining": "Machining",
    "process": "General",
}

# Domains by keyword, in order.
DOMAIN_KEYWORDS = {
    "Sheetmetal": ["sheet metal", "bend", "flange", "hem", "cutout", "emboss", "gusset", "louver", "stamp"],
    "Turn": ["turn", "groove", "bore", "relief"],
    "Mill": ["mill", "pocket", "fillet", "chamfer"],
    "Drill": ["drill", "counterbore", "countersink", "tapping"],
    "Injection Moulding": ["injection", "mould", "mold", "rib", "boss", "draft"],
    "Die Cast": ["die cast", "die-cast", "mold wall"],
    "Tubing": ["tube", "tubing", "uniform bend"],
    "Assembly": ["assembly", "fastener", "bolt", "nut", "interference"],
    "Additive": ["additive", "3d print", "layer", "overhang"],
}

# Rule types of the extraction as domains of the schema.
RULE_TYPE_DOMAINS = {
    "Sheetmetal": "Sheetmetal",
    "SMForm": "SMForm",
    "Injection Moulding": "Injection Moulding",
    "Additive": "Additive",
    "Die Cast": "Die Cast",
    "Mill": "Mill",
    "Drill": "Drill",
    "Turn": "Turn",
    "Tubing": "Tubing",
    "Assembly": "Assembly",
    "Model": "Model",
    "General": "General",
    "Plating": "General",
    "sheet metal": "Sheetmetal",
    "injection molding": "Injection Moulding",
}

# Classes of rules by a document's title, then by processes, features and generic words of the rule, in order.
CLASS_TITLES = {
    "Sheetmetal": ["sheet metal"],
    "Injection Moulding": ["injection molding"],
    "Additive": ["additive", "3d printing"],
    "Die Cast": ["die casting"],
    "Mill": ["milling", "cnc"],
    "Drill": ["drilling"],
    "Turn": ["turning", "lathe"],
    "Tubing": ["tubing", "pipe"],
    "Assembly": ["assembly"],
}
CLASS_PROCESSES = {
    "SMForm": ["sheet metal forming"],
    "Sheetmetal": ["sheet metal"],
    "Injection Moulding": ["injection mold", "plastic"],
    "Additive": ["additive", "3d print", "fdm", "sla"],
    "Die Cast": ["die cast", "casting"],
    "Mill": ["mill", "pocket", "machining"],
    "Drill": ["drill", "hole", "tap"],
    "Turn": ["turn", "lathe", "groove"],
    "Tubing": ["tube", "tubing", "pipe", "bend"],
    "Assembly": ["assembly", "fastener", "bolt", "nut"],
}
CLASS_FEATURES = {
    "Sheetmetal": ["flange", "hem", "curl", "emboss", "stamp", "bridge", "card guide"],
    "Injection Moulding": ["boss", "rib", "draft angle", "mold wall", "wall thickness"],
    "Additive": ["print size", "support", "layer height"],
    "Die Cast": ["mold face", "die wall"],
    "Mill": ["pocket", "chamfer", "fillet", "surface finish"],
    "Drill": ["counterbore", "countersink", "hole depth", "thread"],
    "Turn": ["groove", "relief", "bored hole"],
    "Tubing": ["tube bend", "overlap"],
    "Assembly": ["clearance", "interference", "washer", "shank"],
}
CLASS_GENERIC = {"General": ["pmi", "tolerance", "thread standard", "material preference"], "Model": ["bounding box", "volume", "dimension"]}

# Words of a rule that tell its priority and its risk.
HIGH_PRIORITY = [" must ", " shall ", " required ", " do not ", " never "]
MEDIUM_PRIORITY = [" should ", " recommended "]
HIGH_RISK = ["tolerance", "±", "minimum", "maximum", "clearance", "interference", "thickness", "radius", "failure", "crack", "fracture", "safety", "critical"]
MEDIUM_RISK = ["avoid", "ensure", "prevent"]

# Names of geometric entities.
ENTITIES = {
    "hole": "Hole",
    "holes": "Hole",
    "adjacent holes": "Hole",
    "counterbore": "CBHole",
    "counterbores": "CBHole",
    "countersunk hole": "CSHole",
    "countersunk holes": "CSHole",
    "cs hole": "CSHole",
    "countersink": "CSHole",
    "countersinks": "CSHole",
    "emboss": "Emboss",
    "embosses": "Emboss",
    "emboss feature": "Emboss",
    "dimple": "Dimple",
    "dimples": "Dimple",
    "curl": "RolledHem",
    "curls": "RolledHem",
    "bend": "Bend",
    "bends": "Bend",
    "bend line": "Bend",
    "edge": "PartEdge",
    "edges": "PartEdge",
    "edge of a hole": "PartEdge",
}
ENTITY_ROOTS = {"Counterbore": "CBHole", "Countersink": "CSHole", "Counterdrill": "CDHole", "Curl": "RolledHem", "Hem": "Hem", "Edge": "PartEdge"}

# Phrases that need a branching expression.
BRANCH_PHRASES = ["whichever is larger", "whichever is smaller", "greater of", "lesser of", "maximum of", "minimum of"]
GDT_TYPES = ["Flatness", "Straightness", "Circularity", "Cylindricity", "Profile", "Parallelism", "Perpendicularity", "Angularity", "Position", "Concentricity", "Symmetry", "Runout"]

# Domain (lower case): category, thickness variable, its other names.
DOMAIN_CONFIG = {
    "sheetmetal": ("Sheet Metal", "SheetMetal.Thickness", ["ModuleParams.Thickness", "NormalThickness"]),
    "sheet metal": ("Sheet Metal", "SheetMetal.Thickness", ["ModuleParams.Thickness"]),
    "smform": ("Sheet Metal Forming", "SheetMetalForm.NominalThickness", ["ModuleParams.NormalThickness"]),
    "turn": ("Turning", "PartBody.NominalThickness", ["ModuleParams.Thickness"]),
    "turning": ("Turning", "PartBody.NominalThickness", ["ModuleParams.Thickness"]),
    "mill": ("Milling", "PartBody.NominalThickness", ["ModuleParams.Thickness"]),
    "drill": ("Drilling", "PartBody.NominalThickness", ["ModuleParams.Thickness"]),
    "injection moulding": ("Injection Molding", "InjectionMolding.NominalThickness", ["ModuleParams.NominalThickness"]),
    "die cast": ("Die Casting", "PartBody.NominalThickness", ["WallThickness.MinValue"]),
    "additive": ("Additive Manufacturing", "AMFace.MinThickness", ["ModuleParams.NominalThickness"]),
    "assembly": ("Assembly", "Component.Thickness", []),
    "tubing": ("Tubing", "Tube.OuterDiameter", ["ModuleParams.Thickness"]),
    "general": ("General", "PartBody.NominalThickness", ["ModuleParams.Thickness"]),
}
NAME_STOPS = ["should", "must", "is", "are", "shall", "be", "the"]

# Geometric relations: entities needed, takes an expression, other names, function.
GEOMETRY_RELATIONS = {
    "DistanceBetween": (2, True, ["distance", "spacing", "gap", "proximity", "clearance"], "Distance"),
    "OnSamePlane": (2, False, ["plane", "coplanar", "same plane"], "SamePlane"),
    "AdjacentTo": (2, False, ["adjacent", "next to", "touching"], "IsAdjacent"),
    "ClearanceFromEdge": (2, True, ["edge clearance", "edge distance", "from edge"], "Clearance"),
}
