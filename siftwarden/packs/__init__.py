"""Rule packs: what is looked for, as data. How it is evaluated is elsewhere."""
