"""PDF files as tables: parsing, content, layout and writing. Whole files travel as one binary value per row."""
