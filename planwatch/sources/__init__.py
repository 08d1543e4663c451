"""Sources: what comes in as files, links, archives and robots rules."""
