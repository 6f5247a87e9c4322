"""Reading and writing benchmark tables, prompt files, profiles and catalogues."""
