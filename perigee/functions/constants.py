"""Word lists and patterns of the scoring and filtering rules."""

# Words that the scoring tokenizer drops.
STOPWORDS = tuple(
    "a an and are as at be been being by can could did do does for from had has have how if in into is it its may might more most no not of on or our should so such than that the their then there these they this those through to under using via was we were what when where which while who will with would".split()
)

# Phrases that mark incremental work.
INCREMENTAL_MARKERS = ("improved", "enhanced", "extension of", "variant of", "revisiting", "comparative study", "benchmarking", "fine-tuning", "fine tuning")

# Patterns of work that consolidates earlier results (word bounds are added around them).
CONSOLIDATION = (
    "a (?:systematic |comprehensive |brief |short )?(?:survey|review|overview)",
    "survey of",
    "systematic review",
    "literature review",
    "a comparative (?:study|analysis|evaluation)",
    "an empirical (?:study|analysis|evaluation)",
    "benchmark(?:ing|s)?",
    "evaluation of",
    "case study",
    "replication study",
    "position paper",
    "tutorial",
)

# Patterns of evidence for subfield 1702, on normalized text.
CATEGORY_EVIDENCE = (
    r"\bartificial intelligence\b",
    r"\bmachine learning\b",
    r"\bdeep learning\b",
    r"\breinforcement learning\b",
    r"\bneural (?:network|model|representation|architecture)",
    r"\blarge language model|\blanguage model(?:s|ing)?\b|\bllms?\b",
    r"\bgenerative ai\b|\bgenerative model",
    r"\bcomputer vision\b|\bimage (?:classification|segmentation|generation)",
    r"\bnatural language (?:processing|understanding|generation)",
    r"\bknowledge graph\b|\bexpert system\b",
    r"\bmulti[ -]?agent\b|\bautonomous agent\b|\bagent(?:ic)? (?:system|reasoning|planning)",
    r"\brobot(?:ics|ic| learning)\b",
    r"\btransformer(?:s| architecture)?\b|\bdiffusion model\b",
    r"\bgraph neural\b|\bfoundation model\b|\brepresentation learning\b",
    r"\b(?:few|zero)[ -]?shot\b|\bself[ -]?supervised\b|\btransfer learning\b",
    r"\bai[- ](?:based|driven|enabled|assisted|generated)\b",
    r"\b(?:algorithmic|automated) (?:reasoning|planning|decision making)\b",
)

# Words that a proximity match leaves out.
QUERY_STOP_WORDS = tuple("a an and are as at be by for from in is of on or the to via with without system systems method methods".split())

# Joining words that initials skip.
JOINERS = ("of", "the", "and", "for", "a", "an", "in", "on", "to", "with")

# Acronyms and what they stand for.
GLOSSARY = {
    "rag": ("retrieval augmented generation", "retrieval augmented generative"),
    "llm": ("large language model", "large language models"),
    "llms": ("large language models",),
    "nlp": ("natural language processing",),
    "cv": ("computer vision",),
    "rl": ("reinforcement learning",),
    "rlhf": ("reinforcement learning from human feedback",),
    "gan": ("generative adversarial network", "generative adversarial networks"),
    "cnn": ("convolutional neural network", "convolutional neural networks"),
    "rnn": ("recurrent neural network", "recurrent neural networks"),
    "gnn": ("graph neural network", "graph neural networks"),
    "vlm": ("vision language model", "vision language models"),
    "moe": ("mixture of experts",),
    "sae": ("sparse autoencoder", "sparse autoencoders"),
    "peft": ("parameter efficient fine tuning",),
    "lora": ("low rank adaptation",),
    "sft": ("supervised fine tuning",),
    "dpo": ("direct preference optimization",),
    "mcts": ("monte carlo tree search",),
    "ssl": ("self supervised learning",),
    "ood": ("out of distribution",),
    "qa": ("question answering",),
    "asr": ("automatic speech recognition",),
    "tts": ("text to speech",),
    "ocr": ("optical character recognition",),
    "slam": ("simultaneous localization and mapping",),
    "mpc": ("model predictive control",),
    "pde": ("partial differential equation", "partial differential equations"),
    "dft": ("density functional theory",),
    "mri": ("magnetic resonance imaging",),
    "ai": ("artificial intelligence",),
    "agi": ("artificial general intelligence",),
    "hci": ("human computer interaction",),
    "iot": ("internet of things",),
    "api": ("application programming interface",),
}

# Words whose joined spelling is right.
JOINED_NAMES = ("OpenAlex", "GitHub", "YouTube", "iPhone", "eBay", "arXiv", "LaTeX")

# Named entities.
ENTITIES = {"amp": "&", "apos": "'", "gt": ">", "lt": "<", "nbsp": " ", "quot": '"'}

# Knots of the fallback curve (nearest similarity, score).
FALLBACK_KNOTS = ((0.0, 100.0), (0.02, 96.0), (0.08, 88.0), (0.15, 74.0), (0.25, 58.0), (0.35, 42.0), (0.5, 24.0), (0.7, 8.0), (1.0, 2.0))

# Organisations (label, aliases, colour) and people who mark a paper as prominent.
ORGANISATIONS = (
    ("Anthropic", ("anthropic",), "#d97738"),
    ("OpenAI", ("openai",), "#202b29"),
    ("Google DeepMind", ("deepmind",), "#4285f4"),
    ("Meta AI", ("meta ai", "fair"), "#1877f2"),
    ("Microsoft Research", ("microsoft research",), "#737373"),
    ("NVIDIA Research", ("nvidia research", "nvidia"), "#76b900"),
    ("Apple ML", ("apple machine learning", "apple"), "#555555"),
    ("Amazon Science", ("amazon science", "amazon"), "#ff9900"),
    ("xAI", ("xai",), "#333333"),
    ("Mistral AI", ("mistral ai",), "#f08c32"),
    ("Cohere", ("cohere",), "#39594d"),
    ("AI2", ("allen institute for ai", "allen institute for artificial intelligence"), "#5c6ac4"),
    ("Stanford HAI", ("stanford institute for human centered artificial intelligence", "stanford hai"), "#8c1515"),
    ("MIT CSAIL", ("mit csail", "computer science and artificial intelligence laboratory"), "#a31f34"),
    ("BAIR", ("berkeley artificial intelligence research", "bair"), "#003262"),
    ("CMU ML", ("carnegie mellon",), "#c41230"),
    ("Mila", ("mila",), "#6b4eff"),
    ("Vector Institute", ("vector institute",), "#00a6a6"),
    ("Tsinghua AIR", ("institute for ai industry research", "tsinghua"), "#6f2c91"),
    ("Shanghai AI Lab", ("shanghai artificial intelligence laboratory", "shanghai ai laboratory"), "#d12f2f"),
    ("IBM Research", ("ibm research",), "#0f62fe"),
    ("Google Research", ("google research",), "#4285f4"),
    ("Toyota Research", ("toyota research institute",), "#eb0a1e"),
    ("Hugging Face", ("hugging face",), "#d5a400"),
    ("Salesforce AI", ("salesforce ai research", "salesforce research"), "#0d9dda"),
)
PEOPLE = (
    "Yann LeCun", "Geoffrey Hinton", "Yoshua Bengio", "Demis Hassabis", "David Silver", "Fei Fei Li", "Andrew Ng", "Judea Pearl", "Michael I Jordan", "Jurgen Schmidhuber",
    "Ilya Sutskever", "Dario Amodei", "Percy Liang", "Christopher Manning", "Kaiming He", "Timnit Gebru", "Joelle Pineau", "Pieter Abbeel", "Chelsea Finn", "Sergey Levine",
    "Ian Goodfellow", "Oriol Vinyals", "Noam Brown", "Richard Sutton", "Ruslan Salakhutdinov",
)
RESEARCHER_COLOUR = "#477c73"
