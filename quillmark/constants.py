"""Fixed values of the ranking and note semantics, and lists that results depend on."""

# fixed values
EXACT_NAME, SUBSTRING_NAME, SYMBOL_SIM_MIN, SYMBOL_SIM_WEIGHT = 5.0, 3.0, 0.3, 5.0
FILE_SIM_MIN, FILE_SIM_WEIGHT, PATH_MATCH, CENTRALITY_MAX = 0.35, 1.5, 6.0, 0.5
DEFINITION_FACTOR, IMPORT_FACTOR, IMPORT_ONLY_FACTOR, CODE_ONLY_FACTOR = 1.5, 0.2, 0.4, 1.3
RECALL_SEMANTIC, RECALL_KEYWORD, RECALL_RECENCY, RECALL_MIN, RECALL_CANDIDATES = 0.7, 0.2, 0.1, 0.15, 100
DUPLICATE_COSINE, DUPLICATE_JACCARD = 0.92, 0.7
MOST_NOTES, NOTE_BYTES = 1000, 50 * 1024
CONTRADICTION_COSINE, CONTRADICTION_DAYS, CONTRADICTION_DIVERGENCE = 0.85, 7, 0.30
STOP_WORDS = ["a", "an", "the", "and", "or", "of", "to", "in", "on", "at", "is", "it", "we", "i", "for", "as", "by", "be", "are", "was", "with"]
DEFINITION_KINDS = ["function", "async function", "class", "method", "struct", "trait", "impl", "enum", "interface", "type"]
KIND_SHORT = {"function": "fn", "async function": "afn", "class": "cls", "method": "meth", "interface": "iface", "type": "type", "enum": "enum", "struct": "struct", "trait": "trait", "impl": "impl", "export": "exp", "const": "const"}
SKIP_DIRS = ["node_modules", ".git", ".next", "dist", "build", "target", "coverage", "__pycache__", ".venv", "venv", ".DS_Store"]
SOURCE_EXTENSIONS = ["js", "jsx", "ts", "tsx", "mjs", "cjs", "py", "pyi", "rs", "go", "java", "kt", "scala", "rb", "php", "c", "cpp", "cc", "h", "hpp", "cs", "swift", "json", "yaml", "yml", "toml", "md", "txt", "css", "scss", "less", "html", "vue", "svelte", "sql", "sh", "bash", "zsh", "dockerfile"]
CENTROIDS = {1: [-0.7979, 0.7979], 2: [-1.5104, -0.4528, 0.4528, 1.5104], 3: [-2.1520, -1.3440, -0.7560, -0.2451, 0.2451, 0.7560, 1.3440, 2.1520], 4: [-2.7326, -2.0690, -1.6180, -1.2562, -0.9423, -0.6568, -0.3880, -0.1284, 0.1284, 0.3880, 0.6568, 0.9423, 1.2562, 1.6180, 2.0690, 2.7326]}
BOUNDARIES = {1: [0.0], 2: [-0.9816, 0.0, 0.9816], 3: [-1.7480, -1.0500, -0.5006, 0.0, 0.5006, 1.0500, 1.7480], 4: [-2.4008, -1.8435, -1.4371, -1.0993, -0.7996, -0.5224, -0.2582, 0.0, 0.2582, 0.5224, 0.7996, 1.0993, 1.4371, 1.8435, 2.4008]}
