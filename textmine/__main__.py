from textmine.cli import main

main()
