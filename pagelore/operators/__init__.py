"""Plan operators: rules over elements, words, findings, forms and reports."""
