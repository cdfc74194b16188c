"""Word lists, thresholds and patterns that define the scores."""

# --- fixed values: question filters ---
MIN_QUESTION_CHARS, MAX_QUESTION_CHARS, MIN_QUESTION_WORDS = 15, 220, 3
MIN_ANSWER_CHARS, MAX_ANSWER_CHARS, MAX_BODY_CHARS = 400, 1200, 6000
OPENERS = ["what", "why", "how", "when", "where", "which", "who", "is ", "are ", "can ", "could ", "should ", "do ", "does ", "did ", "will ", "would ", "explain", "describe", "compare", "define", "name ", "list ", "give "]
NON_INTERVIEW = [
    "my code", "my project", "my app", "my script", "my server", "my program", "doesn't work", "does not work", "not working", "won't work", "wont work",
    "help me", "please help", "[closed]", "[duplicate]", "[on hold]", "is this a bug", "am i doing", "what am i doing wrong", "any ideas",
    "cannot find", "can't find", "can not find", "unable to install", "error:", "exception:", "stack trace", "traceback", "segfault",
    "recommend a book", "recommend a tool", "which book", "career advice", "should i quit", "is it worth learning", "hiring", "salary", "interview at",
    "off topic", "meta", "downvote", "close vote", "reputation", " my ", " our ", " we ", " us ", "i'm ", "i am ", "i've ", "i have ",
    "anyone", "someone", "somebody", "didn't", "doesn't", "won't", "isn't", "in my", "for me", "our company", "my team", " went ",
]
CODE_PREFIXES = ["import ", "from ", "using ", "#include", "def ", "class ", "public ", "private ", "protected ", "function ", "var ", "const ", "let ", "return ", "if (", "for (", "while (", "<", "$ ", "> ", "SELECT ", "INSERT ", "UPDATE "]
CODE_SUFFIXES = [";", "{", "}", "):"]
STOPWORDS = (
    "a an the is are was were be been being of to in on for with and or but if it its this that these those as at by from into about "
    "do does did can could should would will shall i you we they he she my your our their me what why how when where which who there here "
    "any some not no so than then s t"
).split()
ENTITIES = {"&amp;": "&", "&lt;": "<", "&gt;": ">", "&quot;": '"', "&#39;": "'", "&apos;": "'", "&nbsp;": " ", "&hellip;": "...", "&mdash;": "-", "&ndash;": "-"}

# --- fixed values: domains; a deployment passes its full keyword table, these are the leading terms ---
DIFFICULTIES = ["Beginner", "Intermediate", "Advanced"]
DOMAIN_TERMS = {
    "SQL": (["sql", "inner join", "left join", "group by", "subquery", "primary key"], ["query", "table", "database"]),
    "Database Optimization": (["index", "indexing", "query plan", "execution plan", "sharding", "partitioning"], ["performance", "cache", "tuning"]),
    "OOP": (["object oriented", "polymorphism", "encapsulation", "inheritance", "abstract class"], ["class", "instance", "coupling"]),
    "Design Patterns": (["design pattern", "singleton", "factory pattern", "observer pattern", "dependency injection"], ["pattern", "refactor"]),
    "Microservices": (["microservice", "microservices", "service mesh", "api gateway", "circuit breaker"], ["kafka", "monolith", "distributed"]),
    "Docker": (["docker", "dockerfile", "docker compose", "docker image"], ["container", "registry"]),
    "Kubernetes": (["kubernetes", "kubectl", "k8s", "statefulset", "kubelet"], ["pod", "cluster", "helm"]),
    "REST APIs": (["rest api", "restful", "idempotent", "status code", "graphql"], ["endpoint", "api", "http"]),
    "Concurrency": (["concurrency", "race condition", "deadlock", "mutex", "semaphore"], ["thread", "lock", "asynchronous"]),
    "Algorithms": (["time complexity", "big o", "dynamic programming", "binary search", "shortest path"], ["algorithm", "recursion", "complexity"]),
    "Data Structures": (["data structure", "linked list", "binary tree", "hash table", "priority queue"], ["array", "stack", "queue", "tree"]),
    "Security": (["xss", "csrf", "sql injection", "encryption", "vulnerability"], ["security", "attacker", "authentication"]),
    "Unit Testing": (["unit test", "unit testing", "tdd", "code coverage", "integration test"], ["testing", "assertion"]),
    "System Design": (["system design", "scalability", "load balancer", "high availability", "consistent hashing"], ["architecture", "latency", "throughput"]),
    "Frontend Development": (["react", "angular", "vue", "virtual dom", "redux"], ["frontend", "browser", "css", "javascript"]),
    "Programming Languages": (["garbage collection", "type system", "closure", "generics", "compiler"], ["java", "python", "syntax"]),
}
STRONG_WEIGHT, WEAK_WEIGHT, MIN_DOMAIN_SCORE = 3.0, 1.0, 3.0
FORM_DESIGN = [
    "design", "architect", "trade-off", "tradeoff", "trade off", "pros and cons", "advantages and disadvantages", "why does", "why is", "why do", "compare",
    "when not to", "best strategy", "scale", "scaling", "optimi", "optimis", "improve performance", "would you", "how would", "what happens when",
    "under the hood", "internals", "better approach", "which is faster", "more efficient", "reduce latency", "handle failure", "at scale",
]
FORM_PRACTICAL = [
    "how do i", "how to", "how can i", "how do you", "best way to", "best practice", "should i", "is it possible", "implement", "configure",
    "troubleshoot", "debug", "fix", "handle", "migrate", "set up", "setup", "integrate", "when should", "when to use", "can i use", "is there a way",
    "prevent", "avoid", "ensure", "validate", "write a", "create a", "build a",
]
FORM_DEFINITION = [
    "what is", "what are", "define", "definition of", "what does", "meaning of", "difference between", "explain", "describe", "list", "name the", "types of",
    "purpose of", "used for", "what's the", "whats the", "what do you mean", "who ", "when was",
]
DEPTH_ADVANCED = [
    "cap theorem", "eventual consistency", "consensus", "raft", "paxos", "sharding", "shard", "partition tolerance", "lock-free", "lock free",
    "memory barrier", "memory model", "race condition", "deadlock", "livelock", "garbage collect", "jit", "query plan", "execution plan", "isolation level",
    "mvcc", "np-complete", "np-hard", "amortized", "asymptotic", "dynamic programming", "red-black", "b-tree", "trie", "consistent hashing",
    "circuit breaker", "saga pattern", "service mesh", "event sourcing", "cqrs", "bounded context", "zero trust", "threat model", "side channel",
    "timing attack", "back pressure", "backpressure", "throughput", "latency", "load balanc", "autoscal", "high availability", "fault toleran",
    "disaster recovery", "distributed", "scalab", "concurrency", "concurrent", "parallelism", "profiling", "benchmark", "bottleneck", "replication lag",
    "idempoten", "immutab", "type system", "covarian", "reflection", "metaprogramming", "virtual dom", "hydration", "server side rendering",
    "server-side rendering", "code splitting", "tree shaking", "memoization", "dependency inversion", "liskov", "hexagonal", "clean architecture",
    "microservice", "statefulset", "service discovery", "sidecar", "istio", "mutual tls", "oauth", "csrf", "xss", "sql injection", "privilege escalation",
    "penetration test", "eventual", "partitioning", "normalization", "denormalization", "transaction isolation", "two-phase", "thread safe",
    "thread-safe", "mutex", "semaphore", "atomic", "monad", "complexity", "big o", "cache invalidation", "cold start", "n+1",
]
DEPTH_BASIC = [
    "variable", "loop", "for loop", "while loop", "array", "string", "function", "method", "class", "object", "constructor", "if statement", "boolean",
    "integer", "comment", "git", "html", "css", "div", "tag", "primary key", "foreign key", "http", "get request", "post request", "json", "list",
    "dictionary", "stack", "queue", "print", "syntax", "keyword", "data type", "operator", "return value", "null", "undefined", "try catch", "exception",
    "inheritance", "select", "insert", "update", "delete", "where clause", "unit test", "framework", "library", "package", "module", "component",
    "props", "state", "hook", "directive", "template", "route", "api",
]
BEGINNER_MAX, ADVANCED_MIN, LONG_QUESTION = 3.0, 5.0, 120

# --- fixed values: speech ---
FILLERS = ["um", "uh", "er", "ah", "hmm", "like", "basically", "actually", "literally", "sort", "kind", "right", "okay", "so", "well", "yeah"]
HEDGES = ["maybe", "perhaps", "possibly", "probably", "guess", "think", "suppose", "might", "sort of", "kind of", "not sure", "i believe"]
SCORE_FILLERS = ["um", "uh", "like", "er", "ah", "hmm", "basically", "literally", "right", "you know", "i mean", "kind of", "sort of"]
DISCOURSE = ["firstly", "secondly", "finally", "furthermore", "however", "therefore", "in addition", "moreover", "consequently", "for example", "for instance", "in conclusion", "to summarize", "on the other hand", "as a result"]
TECHNICAL_TERMS = (
    "abstraction,algorithm,api,argument,array,async,asynchronous,authentication,authorization,availability,backend,bandwidth,batch,branch,buffer,bug,cache,"
    "caching,class,client,cluster,compile,complexity,concurrency,consistency,container,cookie,coupling,crash,database,deadlock,debug,dependency,deploy,deployment,"
    "disk,encryption,endpoint,environment,error,exception,framework,frontend,function,garbage collect,hash,header,index,indexing,inheritance,instance,integration,"
    "interface,iterate,latency,library,load balanc,lock,log,memory,method,middleware,migration,mock,module,mutex,network,normalis,normaliz,object,optimis,"
    "optimiz,orm,package,pagination,parameter,parse,partition,performance,pipeline,pointer,polymorphism,pool,port,primary key,process,profil,promise,"
    "protocol,proxy,query,queue,race condition,recursion,refactor,replica,repository,request,response,rollback,route,runtime,scalab,scale,scan,schema,scope,"
    "serialis,serializ,server,session,shard,socket,stack,state,stateless,storage,stream,string,subclass,synchronous,table,test,thread,throughput,timeout,"
    "token,transaction,type,validation,variable,version,webhook,websocket,write"
).split(",")
SCORE_STOP = (
    "the a an and or but if of to in on at for with by from as is are was were be been being do does did have has had will would can could should may might must shall "
    "this that these those it its they them their you your we our i my me he she his her what why how when where which who whom there here then than so such not no yes also very "
    "just about into over under between some any all more most other same own too only s t"
).split()
# phrases; a space stands for white space, patterns apply to text whose words stand between double spaces
CONCRETE = r"for example|for instance|in my (?:last|previous|current)|we (?:built|used|migrated|deployed|reduced|fixed|shipped)|i (?:built|used|migrated|deployed|reduced|fixed|shipped|led|wrote)|[0-9]+ ?(?:%|percent|ms|seconds?|minutes?|hours?|users?|requests?|times|x)"
STRUCTURE = r"first(?:ly)?|second(?:ly)?|third(?:ly)?|then|next|finally|on the other hand|however|therefore|because|the trade ?off|the downside|the benefit|in summary|to summari[sz]e"
MECHANISM = (
    r"because|since|so that|which means|means that|this causes|results? in|leads? to|due to|therefore|as a result|the reason|under the hood|internally|works? by|that way|which is why|"
    r"allows? (?:you|us|it|the)|lets? (?:you|us|it|the)|enables?|prevents?|avoids?|ensures?|guarantees?|rather than|in order to|so (?:you|we|it|the|reads?|writes?)"
)
TRADEOFF = r"trade ?offs?|however|but|whereas|on the other hand|the downside|the cost|at the expense|in exchange|the drawback|compared to|versus|instead of|unlike"
SPECIFIC = r"[0-9]+ ?(?:percent|ms|milliseconds?|seconds?|minutes?|gb|mb|kb|requests?|users?|rows?|queries|times|x)|for (?:example|instance)|in (?:my|our) (?:last|previous|current)"
VAGUE = r"stuff|things?|whatever|something like that|and so on|etc|you know|basically just|kind of like"
DECLINE = (
    r"(?:i|we) (?:really )?(?:do not|don't|dont|cannot|can't) (?:know|remember|recall|answer)|no (?:idea|clue|comment)|not (?:sure|familiar)|(?:never|haven't|have not) (?:heard|used|worked|seen)|"
    r"skip|pass|(?:next|another) question|move on|i'm blank"
)
CLARIFY = r"repeat|rephrase|say that again|one more time|what do you mean|could you clarify|(?:didn't|did not) (?:catch|hear|get)|are you asking"
SINGLE_DECLINES = ["pass", "skip", "next", "none", "nothing"]
SINGLE_FILLERS = ["yes", "no", "okay", "ok", "sure", "maybe", *SINGLE_DECLINES]
INTERVIEWER_ROLES = ["assistant", "ai", "interviewer", "system", "bot"]
CANDIDATE_ROLES = ["user", "candidate", "human", "me"]

# --- fixed values: report ---
BAND_STRONG, BAND_OK, BAND_WEAK = 78.0, 62.0, 48.0
PACE_LOW, PACE_HIGH = 110.0, 160.0
RESOURCES = [
    ("algorithms-book", ["low_technical"]), ("algorithms-course", ["low_technical", "difficulty_cliff"]), ("web-docs", ["domain_web_development"]),
    ("data-systems-book", ["domain_system_design", "domain_microservices", "domain_kubernetes", "domain_docker"]), ("index-guide", ["domain_sql", "domain_database_optimization"]),
    ("security-guide", ["domain_security"]), ("semaphores-book", ["domain_concurrency"]), ("patterns-guide", ["domain_oop", "domain_design_patterns"]),
    ("testing-book", ["domain_unit_testing"]), ("structured-answers", ["no_examples", "low_relevance"]), ("speech-drills", ["low_confidence", "high_fillers", "pace_issue", "hedging"]),
    ("flashcards", ["declined_questions"]), ("mock-rounds", ["declining_trend"]),
]
SECTIONS = {
    "summary": ["summary", "profile", "professional summary", "objective", "about me"],
    "experience": ["experience", "work experience", "professional experience", "employment", "employment history", "work history", "internships", "work"],
    "education": ["education", "academic background", "qualifications", "academics"],
    "skills": ["skills", "technical skills", "competencies", "technologies", "tech stack", "expertise"],
    "projects": ["projects", "personal projects", "key projects", "portfolio"],
    "certifications": ["certifications", "certificates", "licenses", "courses", "training"],
    "awards": ["awards", "achievements", "honors"],
    "languages": ["languages"], "references": ["references", "referees"], "interests": ["interests", "hobbies"], "publications": ["publications", "research", "papers"],
}
MONTHS = ["jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec"]

# --- fixed values: relevance; patterns apply to text whose words stand between double spaces, apostrophes split words ---
PERSONAL_PROMPT = (
    r"tell me about (?:yourself|a time|your)|about yourself|your (?:background|experience|journey|role|career)|walk me through (?:your|a project|the most)|describe a time|"
    r"tell me about something|introduce yourself|a time (?:you|when you)|you ?ve been working|have you worked|anything you ?d like to ask|how would you rate your|"
    r"which project taught you|i see .* on your cv|your cv lists"
)
SELF_REFERENCE = r"i|we|my|our|me|us"
NARRATIVE = (
    r"first|then|after that|eventually|finally|so i|so we|what i did|the result|in the end|which meant|the problem was|the challenge|i learned|i realised|i realized|looking back|because"
)
QUESTION_FORMS = {"what": "what", "why": "why", "how": "how", "when": "when", "explain": "explain", "describe": "describe", "difference": r"difference[\p{L}\p{N}_]*|versus|vs|compare[\p{L}\p{N}_]*"}
ANSWER_FORMS = {
    "what": r"is|are|means?|refers?|defined?|definition|a type|consists?|involves?",
    "why": r"because|since|so that|reason|due to|in order to|therefore|as a result|the benefit|the point",
    "how": r"by|through|using|first|then|step|process|works?|you would|we would|the way",
    "when": r"when|if|during|after|before|in cases?|scenario|situation|use it",
    "difference": r"whereas|while|but|unlike|on the other hand|differs?|difference|versus|vs|compared",
    "explain": r"because|so|which means|that is|in other words|for example|works?",
    "describe": r"first|then|we|i|the system|the process",
}
CONCEPTS = [
    "encapsulation", "inheritance", "polymorphism", "abstraction", "class", "object", "interface",
    "single responsibility", "open closed", "liskov", "interface segregation", "dependency inversion",
    "index", "b-tree", "acid", "transaction", "isolation", "normalization", "foreign key", "join", "query",
    "state", "props", "hook", "useeffect", "usestate", "virtual dom", "re-render", "component", "lifecycle",
    "microservice", "load balancer", "cache", "redis", "sharding", "latency", "throughput", "message queue", "kafka",
    "docker", "container", "kubernetes", "pod", "cluster", "ci/cd", "pipeline", "aws", "terraform", "monitoring",
    "time complexity", "space complexity", "o(n)", "o(log n)", "recursion", "array", "tree", "hash table", "graph",
]
CONCEPT_STOP = ["because", "through", "between", "should", "without", "another", "however", "before", "around"]
NON_TECHNICAL_PHASES = ["greet", "behavior", "behavioural", "wrap"]

# --- fixed values: coarse labels of collected records, the first list with a hit decides ---
COARSE_DOMAINS = {
    "Frontend Development": ["react", "vue", "angular", "next.js", "dom", "html", "css", "tailwind", "frontend", "javascript", "typescript", "ui component"],
    "Database Systems": ["sql", "postgres", "mysql", "mongodb", "database", "query", "index", "table", "schema", "sqlite", "nosql"],
    "DevOps & Cloud": ["docker", "kubernetes", "aws", "cloud", "linux", "bash", "shell", "deploy", "ci/cd", "container", "devops"],
    "System Design": ["microservice", "architecture", "scalability", "load balancer", "cache", "redis", "kafka", "system design", "distributed"],
    "Algorithms & Data Structures": ["tree", "graph", "sort", "search", "binary search", "recursion", "dynamic programming", "stack", "queue", "linked list", "time complexity"],
    "Backend & Web APIs": ["django", "flask", "fastapi", "node.js", "express", "rest api", "endpoint", "backend", "graphql", "http request"],
}
COARSE_OTHER = "General Software Engineering"
COARSE_ADVANCED = ["optimize", "architect", "distributed", "concurrency", "trade-off", "scalability", "dynamic programming"]
COARSE_INTERMEDIATE = ["implement", "algorithm", "database", "difference between", "how would you", "handle"]

# --- fixed values: where a record comes from hints at its domain ---
SITE_PRIORS = {
    "softwareengineering.stackexchange.com": ["OOP", "Design Patterns", "System Design", "Microservices", "REST APIs", "Programming Languages"],
    "codereview.stackexchange.com": ["OOP", "Programming Languages", "Design Patterns", "Unit Testing"],
    "cs.stackexchange.com": ["Algorithms", "Data Structures", "Concurrency"],
    "cstheory.stackexchange.com": ["Algorithms", "Data Structures"],
    "dba.stackexchange.com": ["SQL", "Database Optimization"],
    "devops.stackexchange.com": ["Docker", "Kubernetes", "Microservices", "System Design"],
    "security.stackexchange.com": ["Security"],
    "sqa.stackexchange.com": ["Unit Testing"],
}
PROMPT_PRIORS = {
    "javascript": ["Frontend Development", "Programming Languages"], "react": ["Frontend Development"], "vue": ["Frontend Development"], "angular": ["Frontend Development"],
    "css": ["Frontend Development"], "front-end": ["Frontend Development"], "frontend": ["Frontend Development"], "java": ["Programming Languages", "OOP"],
    "back-end": ["REST APIs", "System Design", "Microservices"], "backend": ["REST APIs", "System Design", "Microservices"], "devops": ["Docker", "Kubernetes"],
    "system design": ["System Design"], "database": ["SQL", "Database Optimization"], "sql": ["SQL"], "python": ["Programming Languages"],
    "node": ["REST APIs", "Programming Languages"], "testing": ["Unit Testing"], "security": ["Security"],
}
PRIOR_WEIGHT, PROMPT_PRIOR_WEIGHT = 1.0, 3.0

# --- fixed values: tracks ---
TRACKS = {
    "software_engineering": ("Software Engineering", ["Java", "C++", "C#", "Python", "Go", "Rust", "Git", "CI/CD", "Object-Oriented Programming (OOP)", "SOLID Principles", "Test-Driven Development (TDD)", "Clean Code", "Problem Solving"]),
    "web_development": ("Web Development", ["React", "Angular", "Vue.js", "Next.js", "Node.js", "Express.js", "NestJS", "TypeScript", "JavaScript", "HTML/CSS", "Tailwind CSS", "GraphQL", "REST API"]),
    "data_science": ("Data Science", ["Machine Learning", "PyTorch", "TensorFlow", "Python", "SQL", "PostgreSQL"]),
    "networking": ("Networking", ["Linux", "Docker", "Kubernetes", "AWS", "Azure", "GCP", "Cybersecurity", "Microservices"]),
    "ui_ux": ("UI/UX", ["HTML/CSS", "Tailwind CSS", "React", "Vue.js"]),
    "business_analysis": ("Business Analysis", ["Agile / Scrum", "API Design"]),
}
TRACK_DOMAINS = {
    "software_engineering": ["OOP", "Design Patterns", "Algorithms", "Data Structures", "Unit Testing", "Programming Languages", "Concurrency"],
    "web_development": ["Frontend Development", "REST APIs", "Security", "Programming Languages"],
    "data_science": ["Algorithms", "Data Structures", "SQL", "Database Optimization", "Programming Languages"],
    "networking": ["Security", "Microservices", "Kubernetes", "Docker", "System Design"],
    "ui_ux": ["Frontend Development"],
    "business_analysis": ["System Design", "Unit Testing", "REST APIs"],
}
DEFAULT_TRACK = "software_engineering"
TRACK_ALIASES = {
    "swe": "software_engineering", "react": "web_development", "node": "web_development", "python": "software_engineering", "frontend": "web_development", "backend": "software_engineering",
    "devops": "networking", "system_design": "software_engineering", "ml": "data_science", "dotnet": "software_engineering", "hr": "business_analysis", "behavioral": "business_analysis",
    "leadership": "business_analysis", "uiux": "ui_ux", "ux": "ui_ux", "ba": "business_analysis", "data": "data_science",
}
DIFFICULTY_ENTRY = {"easy": "Beginner", "beginner": "Beginner", "medium": "Intermediate", "intermediate": "Intermediate", "hard": "Advanced", "advanced": "Advanced"}

# --- fixed values: terms of an answer to ask about, and words that never are ---
PROBE_CONCEPTS = [
    "abstraction", "algorithm", "api", "architecture", "authentication", "authorization", "availability", "backpressure", "batching", "cache", "caching", "ci", "cd", "concurrency",
    "consistency", "containers", "coupling", "deadlock", "dependency", "deployment", "encapsulation", "encryption", "eventual", "failover", "hashing", "hydration", "idempotency", "index",
    "indexes", "indexing", "inheritance", "injection", "latency", "lock", "locking", "logging", "memoization", "microservices", "middleware", "migration", "mocking", "monitoring", "mutex",
    "normalisation", "normalization", "orm", "pagination", "partition", "partitioning", "pipeline", "polymorphism", "pooling", "profiling", "promise", "promises", "queue", "rate",
    "recursion", "refactoring", "replication", "rollback", "scaling", "schema", "serialization", "sharding", "state", "stateless", "throttling", "throughput", "transaction", "transactions",
    "validation", "virtualization", "webhook", "websocket", "websockets",
]
PROBE_PRODUCTS = [
    "angular", "ansible", "aws", "azure", "bash", "css", "django", "docker", "elasticsearch", "express", "fastapi", "flask", "gcp", "git", "github", "graphql", "grpc", "html", "java",
    "javascript", "jenkins", "jest", "jwt", "kafka", "kotlin", "kubernetes", "linux", "mongodb", "mysql", "nginx", "node", "numpy", "oauth", "pandas", "postgres", "postgresql", "pytest",
    "python", "pytorch", "rabbitmq", "react", "redis", "redux", "rest", "rust", "sass", "scala", "spring", "sql", "swift", "tailwind", "tensorflow", "terraform", "typescript", "vue",
    "webpack",
]
PROBE_STOP = [
    "the", "and", "that", "this", "with", "from", "have", "will", "would", "there", "which", "when", "what", "your", "about", "because", "they", "them", "then", "just", "also", "some",
    "very", "were", "been", "into", "like", "than", "more", "most", "other", "such", "only", "over", "after", "before", "make", "made", "using", "used", "use", "work", "worked", "project",
    "projects", "thing", "things", "really", "actually", "basically", "something", "anything", "everything", "know", "think", "going", "want", "need", "good", "well", "much", "many", "time",
    "team", "people", "code",
]

# --- fixed values: turns whose intent is known, to fit the classifier of turns of middle length ---
INTENT_TURNS = {
    "dont_know": [
        "i don't know", "i dont know", "i do not know", "i have no idea", "no idea", "sorry i don't know that", "i'm not sure about this one", "not sure", "i haven't worked with that", "i have never used that",
        "i can't answer that", "i cannot answer this question", "i don't remember", "i forgot", "pass", "skip this question", "next question please", "can we move on", "let's skip that one", "i am blank right now",
        "that's outside my experience", "never heard of it", "no comment", "i studied it but i can't recall", "mata therenne nathi", "danne nathi", "mama danne nae",
    ],
    "clarify": [
        "could you repeat the question", "can you repeat that please", "sorry could you say that again", "what do you mean by that", "can you rephrase the question", "i didn't catch that",
        "could you clarify what you're asking", "do you mean in the context of production", "are you asking about the frontend or the backend", "sorry i missed the last part", "one more time please",
    ],
    "substantive": [
        "a rest api is stateless so every request carries its own authentication context and the server keeps no session",
        "i used react hooks to manage local state and context for the theme, and moved server data into react query",
        "indexes speed reads because the database can seek instead of scanning, but they cost write throughput and disk",
        "in my last project i led the migration from a monolith to three services and we cut deploy time from an hour to ten minutes",
        "polymorphism lets a subclass override behaviour so the caller depends on the interface rather than the concrete type",
        "we handled the race condition with an optimistic lock on the version column and retried the transaction",
        "first i profiled the endpoint, found an n plus one query, then batched the loads and latency dropped by eighty percent",
        "docker packages the app with its dependencies into an image so the same artefact runs identically in staging and production",
        "unit tests isolate one function with mocked collaborators while integration tests exercise the real database",
        "i would start by clarifying the read and write volume, then decide whether we need sharding at all",
        "my name is nimal and i graduated in computer science, i have been building web applications for about three years",
        "the tradeoff is consistency versus availability, so under a partition you have to pick which one to give up",
        "i disagreed with the design, so i wrote a short document with benchmarks and we reviewed it as a team",
        "garbage collection reclaims unreachable objects, and generational collectors assume most objects die young",
        "i validate accessibility with keyboard navigation and a screen reader, not just the contrast checker",
        "we elicited requirements through stakeholder workshops and then wrote acceptance criteria for each user story",
    ],
    "thin": [
        "yes", "no", "yeah i did that", "it is a framework", "for performance", "i used react", "basically the same thing", "it depends", "i think so", "that's correct", "a database", "okay", "sure",
        "just normal testing", "nothing much", "we used docker",
    ],
}

# --- fixed values: questions of a plan that the pool doesn't give, and what a good answer to them touches ---
LEAST_QUALITY = 0.45
OPENING = ("Good to meet you. To start, could you tell me a little about yourself and what you've been working on?", "background, motivation, recent work")
CLOSING = ("Before we wrap up - is there anything you'd like to ask me about the role or the team?", "engagement, curiosity about the role")
SENIOR_YEARS = 3
BEHAVIOURAL_JUNIOR = [
    "Tell me about a time you got stuck on a problem. How did you get unstuck?",
    "Describe a piece of feedback you received that changed how you work.",
    "Tell me about something technical you taught yourself recently, and why.",
]
BEHAVIOURAL_SENIOR = [
    "Tell me about a technical decision you made that turned out to be wrong. What did you do next?",
    "Describe a time you disagreed with a teammate on an approach. How was it resolved?",
    "Tell me about a time you had to ship something under a hard deadline with known trade-offs.",
]
BEHAVIOURAL_EXPECTS = "situation, action, result, reflection"
# what a CV must have, the question about it, what it expects; in order
CV_QUESTIONS = [
    ("project", "I see %s on your CV. Walk me through your role in it - what did you build, and what was the hardest technical part?", "scope, ownership, technical difficulty, outcome"),
    ("experience", "Your CV lists your time as %s. What was the system you owned there, and what would you change about it now?", "ownership, architecture, hindsight, trade-offs"),
    ("two technologies", "You list both %s and %s. Tell me about a time you had to make them work together - what was tricky about it?", "integration, debugging, real project detail"),
    ("technology", "How would you rate your depth in %s, and what's the most advanced thing you've done with it?", "self-assessment, concrete advanced usage"),
    ("years", "Across roughly %s years of experience, which project taught you the most, and what was the lesson?", "reflection, growth, specific lesson"),
    ("certification", "You hold %s. How have you applied that in practice rather than just in the exam?", "applied knowledge, practical example"),
    ("education", "You studied %s. Which module or project from it maps most closely to the work you want to do now?", "academic-to-practical mapping, motivation"),
]

# --- fixed values: what a CV shows; patterns apply to lower-case text ---
TECHNOLOGIES = {
    "Python": r"\bpython\b",
    "JavaScript": r"\b(javascript|es6\+?|ecmascript)\b",
    "TypeScript": r"\btype\s?script\b",
    "Java": r"\bjava\b(?!\s*script)",
    "C++": r"\bc\+\+\b",
    "C#": r"(\bc#|\bc\s?sharp\b|\b\.net\b)",
    "Go": r"\b(golang|go\s+lang)\b",
    "Rust": r"\brust\b",
    "PHP": r"\bphp\b",
    "Ruby": r"\bruby(\s+on\s+rails)?\b",
    "Kotlin": r"\bkotlin\b",
    "Swift": r"\bswift\b",
    "Dart / Flutter": r"\b(dart|flutter)\b",
    "R": r"(?<![a-z])r\s+(programming|language)\b",
    "React": r"\breact(\.?js)?\b",
    "React Native": r"\breact\s+native\b",
    "Angular": r"\bangular(\s?js)?\b",
    "Vue.js": r"\bvue(\.?js)?\b",
    "Next.js": r"\bnext\.?js\b",
    "Svelte": r"\bsvelte(kit)?\b",
    "Node.js": r"\bnode(\.?js)?\b",
    "Express.js": r"\bexpress(\.?js)?\b",
    "NestJS": r"\bnest\.?js\b",
    "Django": r"\bdjango\b",
    "Flask": r"\bflask\b",
    "FastAPI": r"\bfast\s?api\b",
    "Spring Boot": r"\bspring\s?(boot|framework|mvc)\b",
    "Laravel": r"\blaravel\b",
    "ASP.NET": r"\basp\.?net\b",
    "jQuery": r"\bjquery\b",
    "HTML/CSS": r"\b(html5?|css3?|scss|sass|less)\b",
    "Tailwind CSS": r"\btailwind(\s?css)?\b",
    "Bootstrap": r"\bbootstrap\b",
    "SQL": r"\bsql\b(?!\s*server\s+reporting)",
    "MySQL": r"\bmy\s?sql\b",
    "PostgreSQL": r"\b(postgre\s?sql|postgres)\b",
    "SQL Server": r"\b(ms\s?sql|sql\s+server)\b",
    "Oracle DB": r"\boracle\s*(db|database|11g|12c|19c)\b",
    "MongoDB": r"\bmongo\s?db\b|\bmongoose\b",
    "Redis": r"\bredis\b",
    "Elasticsearch": r"\belastic\s?search\b",
    "Firebase": r"\bfirebase\b",
    "GraphQL": r"\bgraph\s?ql\b",
    "REST API": r"\brest(ful)?\s*apis?\b",
    "gRPC": r"\bgrpc\b",
    "Kafka": r"\b(apache\s+)?kafka\b",
    "RabbitMQ": r"\brabbit\s?mq\b",
    "Docker": r"\bdocker\b",
    "Kubernetes": r"\b(kubernetes|k8s)\b",
    "Terraform": r"\bterraform\b",
    "Ansible": r"\bansible\b",
    "Jenkins": r"\bjenkins\b",
    "CI/CD": r"\b(ci\s?/?\s?cd|continuous\s+(integration|deployment|delivery)|github\s+actions|gitlab\s+ci)\b",
    "AWS": r"\b(aws|amazon\s+web\s+services|ec2|s3\s+bucket|lambda)\b",
    "Azure": r"\b(microsoft\s+)?azure\b",
    "GCP": r"\b(gcp|google\s+cloud)\b",
    "Linux": r"\b(linux|ubuntu|debian|centos|unix|bash\s+script)\b",
    "Git": r"\b(git|github|gitlab|bitbucket)\b",
    "Nginx / Apache": r"\b(nginx|apache\s+(http|web|tomcat))\b",
    "Microservices": r"\bmicro\s?services?\b",
    "System Design": r"\b(system\s+design|software\s+architecture|distributed\s+systems?)\b",
    "TensorFlow": r"\btensor\s?flow\b",
    "PyTorch": r"\bpy\s?torch\b",
    "scikit-learn": r"\b(scikit[\s-]?learn|sklearn)\b",
    "Pandas / NumPy": r"\b(pandas|numpy)\b",
    "Machine Learning": r"\b(machine\s+learning|deep\s+learning|neural\s+network|\bnlp\b|computer\s+vision)\b",
    "Power BI / Tableau": r"\b(power\s?bi|tableau)\b",
    "Figma": r"\b(figma|adobe\s+xd|sketch\s+app)\b",
    "Selenium": r"\bselenium\b",
    "Jest / Pytest": r"\b(jest|pytest|junit|mocha|jasmine|cypress|playwright)\b",
    "Cybersecurity": r"\b(penetration\s+testing|pen\s?test|owasp|vulnerability\s+assessment|ethical\s+hacking)\b",
    "Networking": r"\b(tcp/ip|subnetting|ccna|routing\s+and\s+switching|firewall|vlan)\b",
}
SKILLS = {
    "Object-Oriented Programming (OOP)": r"\b(oop|object[\s-]?oriented)\b",
    "SOLID Principles": r"\bsolid\s+(principles?|design)\b",
    "Design Patterns": r"\bdesign\s+patterns?\b",
    "Data Structures & Algorithms": r"\b(data\s+structures?|algorithms?|\bdsa\b|competitive\s+programming)\b",
    "Test-Driven Development (TDD)": r"\b(tdd|test[\s-]driven|unit\s+test)\b",
    "Agile / Scrum": r"\b(agile|scrum|kanban|sprint\s+planning)\b",
    "Clean Code": r"\bclean\s+code\b",
    "API Design": r"\bapi\s+design\b",
    "Performance Optimization": r"\b(performance\s+(tuning|optimi[sz]ation)|query\s+optimi[sz]ation|latency\s+reduction)\b",
    "Requirements Engineering": r"\b(requirement[s]?\s+(gathering|analysis|elicitation)|user\s+stor(y|ies)|use\s+case)\b",
    "UI/UX Design": r"\b(ui/ux|user\s+experience|wireframe|prototyp|usability)\b",
    "Technical Leadership": r"\b(mentor(ed|ing)?|led\s+a\s+team|team\s+lead|code\s+review)\b",
    "Problem Solving": r"\bproblem[\s-]solving\b",
    "Version Control": r"\b(version\s+control|branching\s+strategy|git\s?flow)\b",
}
NOT_A_NAME = r"(?i)\b(curriculum\s+vitae|resume|cv|profile|address|phone|mobile|email|tel|contact|linkedin|github|nationality|date\s+of\s+birth|dob|gender|marital|www|http)\b"
JOB_TITLE = (
    r"(?i)\b((?:senior|junior|lead|principal|staff|associate|assistant|chief|head\s+of|trainee|intern|graduate)?\s*"
    r"(?:software|full[\s-]?stack|front[\s-]?end|back[\s-]?end|web|mobile|devops|site\s+reliability|cloud|data|machine\s+learning|ml|ai|qa|test|"
    r"security|network|systems?|database|business|ui/ux|ux|ui|product|project)?"
    r"\s*(?:engineer|developer|programmer|analyst|architect|administrator|designer|scientist|consultant|manager|lead|specialist|intern|trainee))\b"
)
DEGREE = (
    r"(?i)\b(ph\.?d|doctorate|m\.?sc|m\.?s\.?c|master(?:'?s)?(?:\s+of\s+\w+)?|m\.?eng|m\.?b\.?a|m\.?tech|b\.?sc|b\.?s\.?c|bachelor(?:'?s)?(?:\s+of\s+\w+)?|b\.?eng|b\.?tech|b\.?it|"
    r"hnd|higher\s+national\s+diploma|advanced\s+diploma|diploma|associate\s+degree|foundation|a\s*/?\s*l|g\.?c\.?e)\b"
)
DEGREE_NAMES = {"bsc": "B.Sc.", "bs": "B.Sc.", "beng": "B.Eng.", "btech": "B.Tech.", "bit": "B.IT", "msc": "M.Sc.", "ms": "M.Sc.", "meng": "M.Eng.", "mtech": "M.Tech.", "mba": "MBA", "phd": "Ph.D.", "hnd": "HND", "highernationaldiploma": "HND"}
INSTITUTION = r"(?i)\b(university|institute|college|academy|campus|polytechnic|school\s+of)\b"
INSTITUTION_TAIL = r"(?i)[,;|(\[]?\s*(?:(?:19|20)\d{2}\s*(?:-|–|—|to)?\s*(?:(?:19|20)\d{2}|present|current)?|gpa[\s:]*[\d.]+|cgpa[\s:]*[\d.]+|first\s+class.*|second\s+class.*)\s*[)\]]?\s*$"
FIELD_OF_STUDY = r"(?i)\bin\s+([^,;|()\n]{3,45}?)\s*(?:,|;|\||\(|$|\bat\b|\bfrom\b|\buniversity\b|\binstitute\b|\bcollege\b|\bacademy\b|\bcampus\b|\bschool\b)"
CERTIFICATION = (
    r"(?i)\b((?:aws|azure|gcp|google|microsoft|oracle|cisco|comptia|scrum|pmi|kubernetes|red\s?hat|salesforce|ibm|isc2)\s*[\w\s+#/.-]{0,45}?"
    r"(?:certified|certificate|certification|professional|associate|practitioner|ccna|ccnp|ccie|security\+|network\+|a\+|cissp|ceh|psm|pmp|cka|ckad|rhcsa|rhce)[\w\s+#/.-]{0,25})"
)
NOT_A_PROJECT = ["developed", "implemented", "responsible", "worked", "used", "built using", "technologies", "tech stack", "tools"]
